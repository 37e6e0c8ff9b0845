"""Token ids in binary shards with a minimal perfect hash index for constant-time access by document key.

File format of a shard, little-endian: magic "TSH1" ("TSH0" without keys), then nine unsigned 64-bit numbers: documents, ids, bytes per id
(2 or 4), first document's global start, number of hash levels, and the offsets of the sections levels, slots, keys and payload.
  levels   per level: number of 64-bit words, then the level's bit field
  slots    per hash value: fingerprint u32 of the key, ordinal u32 of the document
  keys     the document keys in ascending order, i64
  starts   ids before each document in the shard, u64, one more than documents
  payload  raw ids
A key is hashed level by level; the first level whose bit is set gives its rank, which is its place in the slots. The stored
fingerprint tells foreign keys apart (one in 2**32 passes). Shards hold ranges of keys in ascending order, `docs_per_shard` documents at
most, so the index that a lookup reads is small; of the payload it reads only the ids asked for.

Defined results: null texts count as empty, and every document gets the end id. Documents without doc_id stand behind all others, in
shards without keys: they have their ids and starts, but no lookup finds them. Rows that repeat a doc_id follow one another in the order
of a hash of their text, and the index leads to the first; very long texts are encoded whole; extra columns, whatever their names, are ignored; an
empty table writes no shard. Files are written under a name of their own per attempt and then renamed, so a repeated task can't tear one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, worker_table

MAGIC, KEYLESS = b"TSH1", b"TSH0"
_HEAD = struct.Struct("<4s9Q")
_SLOT = np.dtype([("f", "<u4"), ("o", "<u4")])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * _MIX
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0..n-1 without gaps: levels of bit fields, each bit set by exactly one of the keys that reach it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # each a bit field as u64 words
        self.before, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            bits = -(-max(64, int(len(rest) * load)) // 64) * 64
            at = (_hash(rest, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where no level knows it."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, words in enumerate(self.levels):
            at = (_hash(keys[open_], i) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[i][word] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


def shard_bytes(keys: np.ndarray, counts: np.ndarray, payload: bytes, width: int, start: int = 0, keyed: bool = True) -> bytes:
    """A shard file for documents in ascending order of key, or for some without keys."""
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if keyed and len(keys) else np.zeros(len(keys), bool)
    distinct, ordinal = keys[first], np.flatnonzero(first)
    mph = PerfectHash.build(distinct)
    places = mph.places(distinct)
    slots = np.zeros(len(distinct), _SLOT)
    slots["f"][places], slots["o"][places] = _fingerprint(distinct), ordinal
    levels = b"".join(struct.pack("<Q", len(w)) + w.tobytes() for w in mph.levels)
    starts = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
    parts = [levels, slots.tobytes(), keys.astype("<i8").tobytes(), starts.tobytes() + payload]
    at = np.cumsum([_HEAD.size, *map(len, parts)]).tolist()
    return _HEAD.pack(MAGIC if keyed else KEYLESS, len(keys), int(starts[-1]), width, start, len(mph.levels), *at[:4]) + b"".join(parts)


class Shard:
    """A shard file that is open for keyed access: read(offset, size) gives bytes of it. Only the index is read at once."""

    def __init__(self, read):
        self.read = read
        magic, self.n, self.ids, self.width, self.start, n_levels, *self.at = _HEAD.unpack(read(0, _HEAD.size))
        if magic not in (MAGIC, KEYLESS):
            raise ValueError("not a shard file")
        self.keyed = magic == MAGIC
        index, levels, pos = read(self.at[0], self.at[2] - self.at[0]), [], 0
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", index, pos)
            levels.append(np.frombuffer(index, "<u8", n, pos + 8))
            pos += 8 + 8 * n
        self.mph = PerfectHash(levels)
        self.slots = np.frombuffer(index, _SLOT, offset=pos)

    @classmethod
    def of_bytes(cls, data: bytes) -> Shard:
        return cls(lambda at, size: data[at : at + size])

    def keys(self) -> np.ndarray:
        return np.frombuffer(self.read(self.at[2], 8 * self.n), "<i8")

    def starts(self, first: int = 0, count: int | None = None) -> np.ndarray:
        return np.frombuffer(self.read(self.at[3] + 8 * first, 8 * (self.n + 1 if count is None else count)), "<u8").astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinals of keys in the shard, -1 for keys that it doesn't hold."""
        place = self.mph.places(keys)
        known = place >= 0
        out = np.full(len(keys), -1, np.int64)
        slot = self.slots[place[known]]
        out[known] = np.where(slot["f"] == _fingerprint(keys[known]), slot["o"], -1)
        return out

    def ids_at(self, ordinal: int) -> np.ndarray:
        """The ids of a document: two short reads."""
        begin, end = self.starts(ordinal, 2).tolist()
        return np.frombuffer(self.read(self.at[3] + 8 * (self.n + 1) + begin * self.width, (end - begin) * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        at = int(self.find(np.array([key]))[0])
        return None if at < 0 else self.ids_at(at)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next free letter from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Encoded(dict):
    """Ids, as bytes, of runs without white space; bounded. Runs are encoded by the tokenizers library."""

    def __init__(self, path: str, width: int, most: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        # The array module's codes for unsigned integers; the files are little-endian, as are all of Spark's usual hosts.
        self.tokenizer, self.kind, self.most = Tokenizer.from_file(path), {2: "H", 4: "I"}[width], most
        self.model = self.tokenizer.model

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        plain = run.isascii() or ("\u0130" not in run and "\u03a3" not in run and is_normalized("NFC", run))
        if plain and run.isalpha():
            # One piece of letters: the normaliser only lowers it, and the model takes its bytes as letters.
            own = run.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            out = array(self.kind, [t.id for t in self.model.tokenize(own)]).tobytes()
        elif len(run) > 1 and plain and run[-1] in ".,;:!?" and run[:-1].isalpha():
            # Letters and the mark behind them are pieces of their own, unless the normaliser adds marks.
            out = self[run[:-1]] + self[run[-1]]
        else:
            out = self.whole(run)
        if len(run) <= 48:
            self[run] = out
        return out

    def whole(self, text: str) -> bytes:
        (out,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array(self.kind, out.ids).tobytes()


#: str.split() takes these for white space, the tokenizer does not; special tokens may hold anything.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def encode_text(text: str | None, path: str, width: int = 4) -> bytes:
    """The tokenizer's ids of a whole text. Its pieces never cross white space, so runs between white space are encoded one by one
    and remembered; texts with odd characters go through whole."""
    if not text:
        return b""
    known = worker_table(("token ids", path, width), lambda: _Encoded(path, width))
    if any(c in text for c in _ODD):
        return known.whole(text)
    return b"".join(map(known.__getitem__, text.split()))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as an address that means the same on all machines: a plain path belongs to the cluster's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(address: str):
    """The address's file system and path; pyarrow serves local paths and the usual remote stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address if "://" in address else address.replace("file:", "file://", 1))


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that the vocabulary's ids need."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, docs_per_shard: int = 8192, shard_bytes_most: int = 64 << 20) -> DataFrame:
    """Writes the shards and returns the manifest (shard, path, first_id, last_id, documents, ids, start), in ascending doc_id order.

    Documents are dealt by ranges of doc_id; a range is written in shards of at most `docs_per_shard` documents, one after another.
    """
    width, address = id_width(tokenizer, end_id), _qualified(docs.sparkSession, folder)
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        files, base = _store(address)
        files.create_dir(base, recursive=True)
        part, keys, counts, ids, n, size = TaskContext.get().partitionId(), [], [], [], 0, 0

        def flush(keyed: bool) -> pd.DataFrame:
            nonlocal n, size
            k, c = np.array(keys if keyed else [0] * len(keys), np.int64), np.array(counts, np.int64)
            name = f"{base}/ids-{part:05d}-{n:05d}-{uuid.uuid4().hex[:8]}.tsh"
            with files.open_output_stream(name + ".part") as f:
                f.write(shard_bytes(k, c, b"".join(ids), width, keyed=keyed))
            files.move(name + ".part", name)
            row = pd.DataFrame({"part": [part], "number": [n], "path": [name], "first_id": [k[0]], "last_id": [k[-1]], "keyed": [keyed], "documents": [len(k)], "ids": [int(c.sum())]})
            n, size = n + 1, 0
            keys.clear(), counts.clear(), ids.clear()
            return row

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if keys and (len(keys) >= docs_per_shard or size >= shard_bytes_most or (key is None) != (keys[-1] is None)):
                    yield flush(keys[-1] is not None)
                x = encode_text(text.as_py(), tokenizer, width) + end
                keys.append(key), counts.append(len(x) // width), ids.append(x)
                size += len(x)
        if keys:
            yield flush(keys[-1] is not None)

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for row in lean(run(batches)):
            yield pa.RecordBatch.from_pandas(row, preserve_index=False)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    ordered = ordered.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    written = ordered.mapInArrow(write, "part long, number long, path string, first_id long, last_id long, keyed boolean, documents long, ids long")
    path = f"{folder}/manifest"
    written.write.parquet(path)
    # One row per shard: a shard holds thousands of documents, and range partitions are in order.
    manifest = docs.sparkSession.read.schema(written.schema).parquet(path)
    order = Window.orderBy("part", "number")
    own = lambda c: F.when(F.col("keyed"), F.col(c)).alias(c)
    return manifest.select(
        (F.row_number().over(order) - 1).alias("shard"), "path", own("first_id"), own("last_id"), "documents", "ids",
        (F.sum("ids").over(order) - F.col("ids")).alias("start"),
    )


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back through each shard's index."""
    address = _qualified(manifest.sparkSession, folder)

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        files, _ = _store(address)
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                with files.open_input_stream(path) as f:
                    shard = Shard.of_bytes(f.read())
                keys, at = shard.keys(), np.arange(shard.n)
                if shard.keyed:
                    # Rows that repeat a key stand behind the one that the index leads to.
                    repeat = at - np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), at, 0))
                    at = shard.find(keys) + repeat
                starts = shard.starts()
                sums = [zlib.crc32(shard.ids_at(i).astype("<u4").tobytes()) for i in at]
                ids = pd.array(keys, "Int64") if shard.keyed else pd.array([None] * shard.n, "Int64")
                yield pd.DataFrame({"doc_id": ids, "start": start + starts[at], "n_tokens": starts[at + 1] - starts[at], "ids_crc32": np.array(sums, np.int64)})

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.select("path", "start").mapInPandas(lambda batches: lean(run(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) of the keys that the store holds: keys are dealt to shards by range, then found by hash.

    Of a shard's file the index and the ids asked for are read. The manifest (a row per shard) is joined by range; Spark broadcasts it while small.
    """
    import pandas as pd

    address = _qualified(spark, folder)
    keyed = manifest.where("first_id is not null")
    bounds = keyed.select("path", "last_id", F.lag("last_id").over(Window.orderBy("shard")).alias("before_id"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        files, _ = _store(address)
        with files.open_input_file(key[0]) as f:
            shard = Shard(lambda at, size: f.read_at(size, at))
            wanted = pdf["doc_id"].to_numpy()
            at = shard.find(wanted)
            ids = [shard.ids_at(i).astype(np.int64).tolist() for i in at[at >= 0]]
        return pd.DataFrame({"doc_id": wanted[at >= 0], "ids": pd.Series(ids, dtype=object)})

    # A key that two shards share is in the first one's index.
    within = (F.col("doc_id") <= F.col("last_id")) & (F.col("before_id").isNull() | (F.col("doc_id") > F.col("before_id")))
    dealt = keys.select("doc_id").where("doc_id is not null").distinct().join(bounds, within)
    return dealt.groupBy("path").applyInPandas(run, "doc_id long, ids array<long>")


def store_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the shards to the shared folder and reads all of them back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer), folder)
