"""Byte-level BPE by dynamic programming over prefixes.

Of every byte prefix of a piece exactly one token can be the last one of the prefix's encoding. Storing that token per
prefix makes appends exact (the table only grows) and lets an edit re-encode only until the table meets its old self.
A token fits behind its predecessor if no merge across their border would have come before the merges that built
both; the check walks the two tokens' inner spines and is remembered per pair.

Defined results: null texts count as empty and give no ids; every row is encoded by itself, so repeated rows and doc_ids, null doc_ids
and ties need no rule; very long texts are encoded whole, in pieces; extra columns, whatever their names, are ignored; an empty table
gives an empty result; ids that the vocabulary lacks raise ValueError on decoding, and a vocabulary that lacks a byte of a text raises KeyError.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import lean, slices, worker_table

NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Encodes pieces of bytes by ranks; its memory of pairs of tokens is bounded by `most_kept` entries."""

    def __init__(self, ranks: dict[bytes, int], most_kept: int = 300_000):
        self.ranks, self.most_kept = ranks, most_kept
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token, or None if merging its bytes doesn't end in the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at, best = -1, NEVER
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if r < best:
                    at, best = i, r
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1])

    def spines(self, token: int) -> tuple[list, list] | None:
        """Right and left spine of a token, outermost first: (bytes, rank of its own merge, rank at which it is merged away); None: never made."""
        if token in self._spines:
            return self._spines[token]
        whole = self.bytes_of[token]
        own = token if len(whole) > 1 else -1
        right, left = [(whole, own, NEVER)], [(whole, own, NEVER)]
        made: tuple[list, list] | None = (right, left)
        if len(whole) > 1:
            halves = self._halves(whole)
            inner = None if halves is None else (self.spines(self.ranks[halves[0]]), self.spines(self.ranks[halves[1]]))
            if inner is None or inner[0] is None or inner[1] is None:
                made = None
            else:
                (first, made_first, _), (last, made_last, _) = inner[0][1][0], inner[1][0][0]
                right += [(last, made_last, token), *inner[1][0][1:]]
                left += [(first, made_first, token), *inner[0][1][1:]]
        self._spines[token] = made
        return made

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just these two."""
        known = self._fits.get((a, b))
        if known is None:
            x, y = self.spines(a), self.spines(b)
            known = x is not None and y is not None and not self._crossed(x[0], y[1])
            if len(self._fits) >= self.most_kept:
                self._fits.clear()
            self._fits[a, b] = known
        return known

    def _crossed(self, right: list, left: list) -> bool:
        # Leftmost first among equal ranks: a tie is lost to the left token's own merge, won against the right one's.
        rank_of = self.ranks.get
        for x, begin_x, end_x in right:
            for y, begin_y, end_y in left:
                if begin_y < end_x and begin_x < end_y:  # else never side by side
                    r = rank_of(x + y)
                    if r is not None and r < end_x and r <= end_y:
                        return True
        return False

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> None:
        """Fills last[i], the last token of piece[:i + 1], from where the table ends."""
        token_of, known, sizes = self.ranks.get, self._fits.get, self.sizes
        for at in range(len(last), len(piece) if upto is None else upto):
            # One token fits only, so the order of trial is free: first the last token grown by the byte, then the byte alone.
            end, grown = at + 1, at - sizes[last[-1]] if last else 0
            for begin in (grown, at, *range(at - 1, max(0, end - self.longest) - 1, -1)) if grown < at else (at,):
                token = token_of(piece[begin:end])
                if token is None:
                    continue
                if begin:
                    pair = (last[begin - 1], token)
                    ok = known(pair)
                    if ok is None:
                        ok = self.fits(*pair)
                else:
                    ok = self.spines(token) is not None
                if ok:
                    last.append(token)
                    break
            else:
                raise KeyError(f"no token ends at byte {end}")

    def table(self, piece: bytes) -> list[int]:
        """The last token of every prefix."""
        last: list[int] = []
        self.extend(piece, last)
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that a table stands for, read from its end."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= self.sizes[last[end - 1]]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(self.table(piece))


class EditablePiece:
    """A piece with its table: appends are exact, edits re-encode until the table agrees with the old one again."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, piece, encoder.table(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replaces piece[start:end]; returns how many prefixes were encoded anew."""
        old, shift = self.last, len(new) - (end - start)
        piece = self.piece[:start] + new + self.piece[end:]
        last, agreed, done = old[:start], 0, 0
        while len(last) < len(piece):
            self.encoder.extend(piece, last, len(last) + 1)
            done += 1
            at = len(last)
            # A token that ends here looks back `longest` bytes: so many equal entries behind the edit fix all later ones.
            agreed = agreed + 1 if at > start + len(new) and old[at - 1 - shift] == last[-1] else 0
            if agreed >= self.encoder.longest:
                last += old[at - shift :]
                break
        self.piece, self.last = piece, last
        return done

    def tokens(self) -> list[int]:
        whole = self.encoder.ranks.get(self.piece)
        return [whole] if whole is not None else self.encoder.tokens(self.last)


class _Parts(dict):
    """Ids, as bytes, of pieces that the pattern makes, in two generations: when the young one has half of `most` entries it
    turns old, and what is met again returns."""

    def __init__(self, encoder: PrefixEncoder, most: int):
        super().__init__()
        self.encoder, self.young, self.old = encoder, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = array("I", self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.young:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class TextCodec:
    """Whole texts to ids and back; each match of the pattern, any pattern, is encoded separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_kept: int = 300_000):
        import regex

        self.pattern = regex.compile(pattern)
        self.encoder = PrefixEncoder(ranks, most_kept)
        self.parts = _Parts(self.encoder, most_kept)
        self.values = [self.encoder.bytes_of.get(i) for i in range(max(ranks.values(), default=-1) + 1)]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= 1 << 20:
            return b"".join(map(self.parts.__getitem__, self.pattern.findall(text)))
        out = bytearray()
        for m in self.pattern.finditer(text):
            out += self.parts[m.group()]
        return bytes(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.values.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except (IndexError, TypeError):
            raise ValueError("the ids hold one that the vocabulary lacks") from None


class EditableText:
    """A text with its pieces: an edit splits and encodes anew only around itself, with the result of a full encoding."""

    def __init__(self, codec: TextCodec, text: str = ""):
        self.codec, self.text = codec, text
        self.ends = [m.end() for m in codec.pattern.finditer(text)]
        self.ids = [codec.parts[text[a:b]] for a, b in zip([0, *self.ends], self.ends, strict=False)]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replaces text[start:end]; returns how many pieces were encoded anew."""
        import bisect

        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        # The pattern looks one character ahead, and white space gives its last character back.
        keep = max(0, bisect.bisect_left(self.ends, start - 1) - 1)
        at = self.ends[keep - 1] if keep else 0
        old = {e: i for i, e in enumerate(self.ends) if e >= end}
        ends, ids, done = self.ends[:keep], self.ids[:keep], 0
        while at < len(text):
            if at - shift in old and at >= start + len(new):
                i = old[at - shift]
                ends += [e + shift for e in self.ends[i + 1 :]]
                ids += self.ids[i + 1 :]
                break
            m = self.codec.pattern.match(text, at)
            at = m.end()
            ends.append(at)
            ids.append(self.codec.parts[m.group()])
            done += 1
        self.text, self.ends, self.ids = text, ends, ids
        return done

    def encode_bytes(self) -> bytes:
        return b"".join(self.ids)


def codec(path: str, pattern: str) -> TextCodec:
    """One codec a Python process: its tables serve the tasks that the worker runs one after another."""
    return worker_table(("byte BPE", path, pattern), lambda: TextCodec(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers, one row per input row."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for part in slices(b):
                ids = [c.encode_bytes(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(run(batches)), f"doc_id {kind}, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text, then decodes the ids, in one pass."""
    import hashlib

    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for b in slices(batch):
                n, one, two = [], [], []
                for t in b.column("text"):
                    ids = c.encode_bytes(t.as_py() or "")
                    n.append(len(ids) // 4)
                    one.append(hashlib.sha256(ids).hexdigest())
                    two.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(run(batches)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
