"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Every unit vector is turned by random rotations; the signs of a turned vector are its code. A stored factor f, the inner
product of the turned vector and its code's unit vector, makes the estimate <code_x, turned_y> / f unbiased for <x, y>; its error
is of the order sqrt((1 - f^2) / (f^2 * (d - 1))), so a bound of `sigmas` errors tells which pairs can't reach the threshold.
Only the other pairs are recomputed exactly, in double precision.

Bands of code bits name the buckets in which pairs are looked for (within one label), so that no label is compared
as a whole: with 48 bands of 20 bits a pair at cosine 0.98 shares none with probability 4e-7. Buckets are compared
in blocks of `block` vectors; a pair counts in the first band that it shares. Blocks tell counts and spanning links per vector,
never their pairs. Vectors that are equal are compared once, through one of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows without a label and rows
without vec_id link with nothing and are their own component; vectors of different length never link; every row is a vector of its
own, also if its vec_id repeats; component_id is the smallest vec_id; extra columns, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean


@dataclass(frozen=True)
class Codes:
    """threshold: cosine from which vectors link. rotations x dimension bits are cut into bands of `bits`."""

    threshold: float = 0.98
    bands: int = 48
    bits: int = 20
    sigmas: float = 6.0
    block: int = 1024
    seed: int = 7


@cache
def rotations(d: int, codes: Codes) -> np.ndarray:
    """As many random rotations (d x d, orthonormal) as the bands need bits, one below another."""
    rng = np.random.default_rng([codes.seed, d])
    n = -(-codes.bands * codes.bits // d)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0].T for _ in range(n)])


def encode(unit: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band numbers, packed bits of the first rotation, its correction factor) of unit vectors."""
    d = unit.shape[1]
    turned = unit @ rotations(d, codes).T
    bits = turned > 0
    of_bands = bits[:, : codes.bands * codes.bits].reshape(len(unit), codes.bands, codes.bits)
    numbers = of_bands @ (1 << np.arange(codes.bits, dtype=np.int64))
    factor = np.abs(turned[:, :d]).sum(1) / np.sqrt(d)
    return numbers, np.packbits(bits[:, :d], axis=1), factor


def estimate(packed: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors (rows) with exact turned ones (columns), and one error each."""
    d = turned.shape[1]
    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
    found = (signs @ turned.T.astype(np.float32)) / np.sqrt(d) / factor[:, None]
    error = np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, d - 1)))
    return found, error[:, None]


def _numbered(vectors: DataFrame) -> DataFrame:
    """(node, vec_id, label, v array<double>) of every row; v is null where the row can't link. To be written, as nodes are numbered."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound
    return rows.withColumn("v", F.when(able, F.col("v")))


def near_vectors(vectors: DataFrame, codes: Codes = Codes()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    import pandas as pd

    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.keep(_numbered(vectors))
    clean = rows.where("v is not null")
    kind = clean.schema["label"].dataType.simpleString()
    groups = clean.groupBy("label", "v").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))

    def code(batches: Iterable) -> Iterator:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["v"].map(len)):
                v = np.stack(part["v"].to_numpy()).astype(float)
                v = v / np.abs(v).max(1, keepdims=True)
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                numbers, packed, factor = encode(unit, codes)
                yield pd.DataFrame({"label": part["label"], "raw": part["v"], "vec_id": part["rep"], "least": part["least"], "copies": part["copies"], "d": size, "v": list(unit), "bands": list(numbers), "code": [x.tobytes() for x in packed], "factor": factor})

    coded = scratch.keep(groups.mapInPandas(lambda batches: lean(code(batches)), f"label {kind}, raw array<double>, vec_id long, least long, copies long, d int, v array<double>, bands array<long>, code binary, factor double"))
    places = coded.select("label", "d", "vec_id", F.posexplode("bands").alias("band", "number"))
    bucket = ["label", "d", "band", "number"]
    shared = scratch.keep(places.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"))
    members = places.join(shared, bucket).join(coded.drop("label", "d", "raw", "least"), "vec_id")
    parts = F.ceil(F.col("size") / codes.block).cast("int")
    members = members.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("vec_id"), parts).cast("int")})
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(band: int, i: int, j: int, ids: np.ndarray, own: np.ndarray, copies: np.ndarray, v: np.ndarray, of_bands: np.ndarray, code: np.ndarray, factor: np.ndarray):
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n, ends = np.zeros(len(ids), np.int64), [np.zeros((2, 0), np.int64)]
        if len(left) and len(right):
            unit, bands = np.stack(v), np.stack(of_bands)
            packed = np.frombuffer(b"".join(code), np.uint8).reshape(len(ids), -1)
            turned = unit[right] @ rotations(unit.shape[1], codes)[: unit.shape[1]].T
            found, error = estimate(packed[left], factor[left], turned)
            open_ = found + codes.sigmas * error >= codes.threshold
            if i == j:
                open_ &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
            for at, x in enumerate(left):
                y = right[open_[at]]
                y = y[(bands[y] == bands[x]).argmax(1) == band]
                # The exact step: inner products of unit vectors in double precision.
                y = y[np.einsum("ij,j->i", unit[y], unit[x]) >= codes.threshold]
                n[x] += copies[y].sum()
                n[y] += copies[x]
                ends.append(np.stack([np.full(len(y), x), y]))
        tops = _tops(len(ids), *np.concatenate(ends, 1))
        some = n > 0
        return ids[some], n[some], ids[tops[some]]

    def run(batches: Iterable) -> Iterator:
        held = None
        for pdf in itertools.chain(batches, [None]):
            last = pdf is None
            pdf = held if last else pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
            if pdf is None or not len(pdf):
                continue
            keys = pdf[["label", "d", "band", "number", "i", "j"]]
            ends = np.append(np.flatnonzero((keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).any(1)) + 1, len(pdf))
            # The last bucket of a batch may go on in the next one.
            done = ends if last else ends[:-1]
            held = None if last else pdf.iloc[(done[-1] if len(done) else 0) :]
            columns = [pdf[c].to_numpy() for c in ("band", "i", "j", "vec_id", "own", "copies", "v", "bands", "code", "factor")]
            told = [compare(*(c[a] for c in columns[:3]), *(c[a:b] for c in columns[3:])) for a, b in itertools.pairwise([0, *done])]
            if told:
                yield pd.DataFrame(dict(zip(("vec_id", "n", "top"), map(np.concatenate, zip(*told, strict=True)), strict=True)))

    order = [*bucket, "i", "j"]
    told = members.select(*order, "own", "vec_id", "copies", "v", "bands", "code", "factor")
    told = told.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "vec_id")
    told = scratch.keep(told.mapInPandas(lambda batches: lean(run(batches)), "vec_id long, n long, top long"))
    label = components(told.select(F.col("vec_id").alias("a"), F.col("top").alias("b")), scratch)
    links = told.groupBy("vec_id").agg(F.sum("n").alias("n"))
    label = label.withColumnRenamed("node", "vec_id")
    low = scratch.keep(coded.join(label, "vec_id").groupBy("component").agg(F.min("least").alias("low")))
    of_rep = coded.select("vec_id", "label", F.col("raw").alias("v"), "copies", "least").join(links, "vec_id", "left").join(label.join(low, "component"), "vec_id", "left")
    of_rep = scratch.keep(of_rep.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id")))
    # Copies of a vector link with each other and with all that their representative links with.
    named = clean.join(of_rep, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tops(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that each of n nodes reaches over the links (x, y)."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[x], top[y])
        then = top.copy()
        for end in (x, y, top[x], top[y]):
            np.minimum.at(then, end, low)
        then = then[then]
        if (then == top).all():
            return top
        top = then


OP1_SQL = """
with raw as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
), sound as (
  select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from raw
  where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach as (
  with recursive r(a, b) as (
    select vec_id, vec_id from embeddings union select r.a, links.b from r join links on r.b = links.a
  ) select a, min(b) as component_id from r group by a
)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join reach on e.vec_id = reach.a
left join (select a, count(*) as n from links group by a) l on l.a = e.vec_id
"""
