"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters a shingle's hash over a circle of 2**32 places, the second
orders the circle; coordinate k reads the second one shifted by k places. Bands of the signature name buckets. A
bucket's members are linked through pairs whose sketches (one byte per coordinate) don't rule the threshold out, and every
link is confirmed on the full sets of word shingles, by the words themselves.

Texts with the same words act through one of them (a 128-bit hash of the word sequence). Only components are asked for, so pairs
inside one component need no test. First each member is tested against the leaders of its buckets that look likeliest; a
large bucket has a leader per part, so a leader's partners stay few. Then, in buckets that still span components, all
pairs between components: buckets of up to `small` members expand to pairs; in larger ones the members outside the bucket's
largest component meet all others in blocks of `block` members and `block_bytes` of text at most (on average). Nothing is capped.

Defined results: null, empty and wordless texts have an empty set, link with nothing and stay; texts with fewer words than a
shingle are one shingle. Every row is a document of its own, also if its doc_id is null or repeats: a component's first row by doc_id
(nulls last), then by a hash of its text, is kept, and of rows equal in both any one. component_id is the smallest doc_id, null where no row has any.
Very long texts are signed as a whole; extra columns, whatever their names, are ignored by `near_duplicates` and kept by
`drop_near_copies`; an empty table gives an empty result. n_shingles counts distinct 64-bit hashes of shingles: two of
20,000 shingles share one with probability 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import Scratch, components, lean, row_key, slices, staying_rows, worker_table

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Bands x rows coordinates; a pair at the threshold of 0.8 is missed with probability (1 - 0.8**rows)**bands.

    held: shingles that a task keeps while it confirms links in a block; beyond it they are built again when needed.
    """

    bands: int = 40
    rows: int = 6
    words: int = 5
    percent: int = 80
    small: int = 8
    block: int = 512
    block_bytes: int = 8 << 20
    held: int = 250_000

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Equal sketch bytes below which a pair is ruled out: five standard deviations under the threshold."""
        p = self.percent / 100
        return int(self.size * p - 5 * (self.size * p * (1 - p)) ** 0.5)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between characters of [\\x20\\x09-\\x0D], A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted."""
    known = worker_table("word hashes", _WordHashes)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for exact verification."""
    words = words_of(text)
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Minima of the circulant permutations over the set, one per shift 0..size-1."""
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        places = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(places), 512):
            v = places[None, i : i + 512] + shifts
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x7FEB352D)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x846CA68B)
            v ^= v >> np.uint32(16)
            np.minimum(best, v.min(1), out=best)
    return best


def band_keys(signatures: np.ndarray, plan: Plan) -> np.ndarray:
    parts = signatures.reshape(len(signatures), plan.bands, plan.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=np.uint64) * _MIX, parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(plan.rows):
            key = (key ^ parts[:, :, k]) * _MIX
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sign(docs: DataFrame, plan: Plan) -> DataFrame:
    """(node, row_key, doc_id, n_shingles, n_bytes, words_key, bands, sketch) of every row of docs(doc_id, text); to be written, as nodes are numbered."""
    import pyarrow as pa
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                n, size, keys, signed = [], [], [], []
                for t in b.column("text"):
                    words = words_of(t.as_py())
                    h = shingle_hashes(words, plan.words)
                    whole = b" ".join(words)
                    n.append(len(h))
                    size.append(len(whole))
                    keys.append(xxhash.xxh3_128_digest(whole))
                    signed.append(signature(h, plan.size))
                s = np.array(signed, np.uint32).reshape(-1, plan.size)
                bands = [k.tolist() if m else [] for k, m in zip(band_keys(s, plan), n, strict=True)]
                sketch = [x.tobytes() for x in (s & np.uint32(255)).astype(np.uint8)]
                made = [pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=[*kept, "n_shingles", "n_bytes", "words_key", "bands", "sketch"])

    kept = ["node", "x", "y", "doc_id"]
    numbered = docs.select(F.monotonically_increasing_id().alias("node"), row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    made = numbered.select("node", "k.x", "k.y", "doc_id", "text").mapInArrow(lambda batches: lean(run(batches)), "node long, x long, y long, doc_id long, n_shingles long, n_bytes long, words_key binary, bands array<long>, sketch binary")
    return made.select("node", F.struct("x", "y").alias("row_key"), "doc_id", "n_shingles", "n_bytes", "words_key", "bands", "sketch")


def verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, linked) for pairs(a, b) of nodes: 100 * intersection >= percent * union on the full sets.

    The partners of a are dealt into `parts` parts; each is a run of rows that a's text heads, so texts aren't repeated per pair and
    a task holds two sets at a time.
    """
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in batches:
            for part in slices(batch):
                a, b, ok = [], [], []
                for x, y, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("text"), strict=True):
                    own = shingle_set(text.as_py(), plan.words)
                    if y is None:
                        known = own
                    else:
                        a.append(x), b.append(y), ok.append(_similar(known, own, plan.percent))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    parts = 16
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part"))
    partners = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "part", "b", "text")
    heads = dealt.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = partners.union(heads).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return runs.select("a", "b", "text").mapInArrow(lambda batches: lean(run(batches)), "a long, b long, linked boolean")


@F.pandas_udf(IntegerType())
def _matches(x, y):
    import pandas as pd

    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
    return pd.Series((a == b).sum(1).astype(np.int32))


def _likely(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """pairs(a, b) with the number of equal sketch bytes, without those that the sketches rule out."""
    x = reps.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    y = reps.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    # Else the planner calls it twice, for the column and below it for the condition, each time in a Python worker of its own.
    once = _matches.asNondeterministic()
    found = pairs.join(x, "a").join(y, "b").select("a", "b", once("sa", "sb").alias("matches"))
    return found.where(F.col("matches") >= plan.least_matches)


def _parts(n: str, n_bytes: str, plan: Plan) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / plan.block), F.ceil(F.col(n_bytes) / plan.block_bytes)).cast("int")


def _linked_in_blocks(members: DataFrame, reps: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that join components inside large buckets, found and confirmed block by block.

    members: (key, node, n_bytes, component). Members of a bucket's largest component stand on the left only, once per
    block of the others; so a bucket whose members were nearly all joined costs little more than its members. A pair is looked
    at only in the first bucket that it shares, and not once its components have met in the block; likelier pairs come first. At
    most one link per component and block is told, so what leaves a block grows with its members, not with its pairs.
    """
    import pandas as pd

    of_part = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    sums = of_part.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.max(F.struct("n", "component", "n_bytes")).alias("main"))
    sums = sums.select("key", F.col("main.component").alias("main"), "n", "n_bytes", (F.col("n") - F.col("main.n")).alias("m"), (F.col("n_bytes") - F.col("main.n_bytes")).alias("m_bytes"))
    sums = sums.select("key", "main", _parts("n", "n_bytes", plan).alias("lefts"), _parts("m", "m_bytes", plan).alias("rights"))
    at = members.select("key", "node", "component").join(sums, "key").withColumn("rare", F.col("component") != F.col("main"))
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = at.select("key", "node", "component", "rare", own("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("left"))
    right = at.where("rare").select("key", "node", "component", "rare", every("lefts").alias("i"), own("rights").alias("j"), F.lit(False).alias("left"))
    dealt = left.union(right).join(reps.select("node", "bands", "sketch"), "node").join(texts, "node")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, comp, rare, side, text = (pdf[c].to_numpy() for c in ("node", "component", "rare", "left", "text"))
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        bands = np.stack(pdf["bands"].to_numpy())
        likely = [np.zeros((0, 3), np.int64)]
        lefts = np.flatnonzero(side)
        for x in np.flatnonzero(~side):
            # Two rare members meet twice, once on either side.
            y = lefts[(comp[lefts] != comp[x]) & (~rare[lefts] | (nodes[lefts] < nodes[x]))]
            m = (sketch[y] == sketch[x]).sum(1)
            y, m = y[m >= plan.least_matches], m[m >= plan.least_matches]
            if len(y):
                here = bands[x][(bands[y] == bands[x]).argmax(1)] == key[0]
                likely.append(np.column_stack([np.full(here.sum(), x), y[here], m[here]]))
        pairs = np.concatenate(likely)
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        sets: dict[int, set] = {}
        held = 0
        links = []
        for x, y, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
            cx, cy = top(comp[x]), top(comp[y])
            if cx == cy:
                continue
            if held > plan.held:
                sets, held = {}, 0
            for k in (x, y):
                if k not in sets:
                    sets[k] = shingle_set(text[k], plan.words)
                    held += len(sets[k])
            if _similar(sets[x], sets[y], plan.percent):
                root[cx] = cy
                links.append((nodes[x], nodes[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def _similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verdicts(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, kept) for every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(sign(docs, plan))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row_key", "node")
    rep = scratch.keep(signed.where("n_shingles > 0").groupBy("words_key").agg(F.min(first).alias("best")))
    reps = signed.join(rep.select(F.col("best.node").alias("node")), "node", "left_semi")
    rows = reps.select(F.explode("bands").alias("key"), "node", "n_bytes")
    shared = rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("size"))
    shared = scratch.keep(shared.where("leader < last").select("key", "leader", "size"))
    members = scratch.keep(rows.join(shared, "key"))
    nodes = members.select("node").distinct()
    reps = scratch.keep(reps.join(nodes, "node", "left_semi").select("node", "row_key", "bands", "sketch"))
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    # Rows with equal keys are equal: one of them lends its text.
    texts = scratch.keep(keyed.join(reps.select("row_key", "node"), "row_key").dropDuplicates(["row_key"]).select("node", "text"))

    # Large buckets have a leader per part, and their own leader for these.
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / plan.block)).cast("int")
    large = members.where(F.col("size") > plan.block).withColumn("part", part)
    heads = large.groupBy("key", "leader", "part").agg(F.min("node").alias("head"))
    star = members.where(F.col("size") <= plan.block).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    star = star.union(heads.select("leader", "head")).union(large.join(heads, ["key", "leader", "part"]).select("head", "node")).where("a <> b").distinct()
    near = Window.partitionBy("b").orderBy(F.desc("matches"), "a")
    likeliest = _likely(star, reps, plan).withColumn("r", F.row_number().over(near)).where("r <= 2").select("a", "b")
    tested = scratch.keep(verified(likeliest, texts, plan))

    linked = tested.where("linked").select("a", "b")
    label = components(linked, scratch)
    at = members.join(label, "node", "left").select("key", "size", "node", "n_bytes", F.coalesce("component", "node").alias("component"))
    at = scratch.keep(at)
    torn = scratch.keep(at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
    open_ = at.join(torn, "key", "left_semi")
    few = open_.where(F.col("size") <= plan.small)
    pairs = (
        few.select("key", F.col("node").alias("a"), F.col("component").alias("ca"))
        .join(few.select("key", F.col("node").alias("b"), F.col("component").alias("cb")), "key")
        .where("a < b and ca <> cb").select("a", "b").distinct()
    )
    pairs = _likely(pairs.join(tested, ["a", "b"], "left_anti"), reps, plan).select("a", "b")
    many = open_.where(F.col("size") > plan.small)
    more = verified(pairs, texts, plan).where("linked").select("a", "b").union(_linked_in_blocks(many, reps, texts, plan))
    links = scratch.keep(linked.union(more))
    scratch.drop(label, at, torn, texts, reps, members, shared, tested)
    label = components(links, scratch)
    # A component's first row, by way of the linked nodes alone.
    of_node = label.join(rep.select(F.col("best.node").alias("node"), "best"), "node").select("node", "component", "best")
    top = scratch.keep(of_node.groupBy("component").agg(F.min("best").alias("top")))
    of_node = of_node.join(top, "component").select("node", "top")
    found = rep.withColumn("node", F.col("best.node")).join(of_node, "node", "left").select("words_key", F.coalesce("top", "best").alias("top"))
    found = scratch.keep(found)
    # Wordless rows have keys of their own, so that they don't meet in one task.
    own = F.when(F.col("n_shingles") > 0, F.col("words_key")).otherwise(F.col("node").cast("string").cast("binary"))
    out = signed.select("node", "row_key", "doc_id", "n_shingles", own.alias("words_key")).join(found, "words_key", "left")
    component = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.id"))
    return out.select("row_key", "doc_id", "n_shingles", component.alias("component_id"), (F.col("top").isNull() | (F.col("top.node") == F.col("node"))).alias("kept"))


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    return verdicts(docs, plan).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows that stay, one of each component, with all their columns."""
    return staying_rows(docs, verdicts(docs.select("doc_id", "text"), plan))
