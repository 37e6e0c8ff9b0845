"""Vector search: a stated set of query vectors against all rows, block by block through matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Vectors of either side in a block.
BLOCK = 2048


def _dealt(queries: DataFrame, rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Both sides in blocks (i, j): every block of queries with every block of rows; `more` are further columns of the queries."""
    side = lambda df, *columns: df.where("v is not null and size(v) > 0").select("id", F.col("v").cast("array<double>").alias("v"), *columns)
    parts = lambda df: max(1, -(-df.count() // BLOCK))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    i, j = parts(queries), parts(rows)
    asked = side(queries, *more).select("id", "v", F.lit(True).alias("asked"), own(i).alias("i"), every(j).alias("j"), *more)
    nulls = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in more]
    given = side(rows).select("id", "v", F.lit(False).alias("asked"), every(i).alias("i"), own(j).alias("j"), *nulls)
    return asked.union(given)


def scored(queries: DataFrame, rows: DataFrame, keep: int = 0) -> DataFrame:
    """(a, b, c, d): cosine (0 for zero vectors) and Euclidean distance of every query (id, v) and every other row (id, v).

    Both sides are dealt into blocks and every two blocks meet in one task's matrix product. With `keep`, a block tells only the pairs among a
    query's `keep` best ones by cosine or by distance (ties by id), so that what leaves it grows with its queries.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        left, right = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "c": [], "d": []}).astype({"a": "int64", "b": "int64"})
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        a, b, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for k in range(0, len(x), 64):
            inner, norm = x[k : k + 64] @ y.T, nx[k : k + 64, None] * ny[None, :]
            c = np.clip(np.divide(inner, norm, out=np.zeros_like(inner), where=norm >= 1e-12), -1.0, 1.0)
            d = np.sqrt(((x[k : k + 64, None, :] - y[None, :, :]) ** 2).sum(2))
            used = a[k : k + 64, None] != b[None, :]
            if keep:
                best = np.zeros_like(used)
                for order in (np.where(used, -np.round(c, 9), np.inf), np.where(used, np.round(d, 9), np.inf)):
                    np.put_along_axis(best, np.argsort(order, axis=1, kind="stable")[:, :keep], True, axis=1)
                used &= best
            at, to = np.nonzero(used)
            out.append(pd.DataFrame({"a": a[k + at], "b": b[to], "c": c[at, to], "d": d[at, to]}))
        return pd.concat(out, ignore_index=True)

    return _dealt(queries, rows).groupBy("i", "j").applyInPandas(run, "a long, b long, c double, d double")


#: Cosines are compared as whole billionths, as if rounded to 9 digits; NaN, the largest value, is UNKNOWN, and the query itself LEAST.
BILLION, UNKNOWN, LEAST = 1e9, 2e9, -2e9
#: Billionths in a bin of the first count: some 8,192 bins from -1 to 1.
BIN = 244_141


def _whole(x: np.ndarray) -> np.ndarray:
    """x in whole billionths, halves away from zero as the SQL engine rounds."""
    size = np.abs(x) * BILLION
    low = np.floor(size)
    return np.copysign(low + (size - low >= 0.5), x) + 0.0


def _blocks(pdf):
    """(query ids, their places, row ids, cosines in billionths, distances of pairs) for every 64 queries of a block."""
    pdf = pdf.sort_values("id")
    left, right = pdf[pdf["asked"]], pdf[~pdf["asked"]]
    if not len(left) or not len(right):
        return
    x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = left["id"].to_numpy(), right["id"].to_numpy()
    for k in range(0, len(x), 64):
        part = x[k : k + 64]
        inner, norm = part @ y.T, nx[k : k + 64, None] * ny[None, :]
        c = np.clip(np.divide(inner, norm, out=np.zeros_like(inner), where=~(norm < 1e-12)), -1.0, 1.0)
        c = np.where(np.isnan(c), UNKNOWN, _whole(c))
        c[a[k : k + 64, None] == b[None, :]] = LEAST

        def distances(at: np.ndarray, to: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            d = np.sqrt(((part[at] - y[to]) ** 2).sum(1))
            return np.where(np.isnan(d), np.inf, _whole(d) / BILLION)

        yield a[k : k + 64], left.iloc[k : k + 64], b, c, distances


def _at(counts: list[tuple[int, int]], place: int) -> int:
    """The value at a place of the order, from sorted (value, count)."""
    for value, n in counts:
        if place < n:
            return value
        place -= n
    raise ValueError("fewer values than counted")


def matched(queries: DataFrame, rows: DataFrame, percent: float, most: int) -> DataFrame:
    """(a, b, rc, rd): each query's `most` best rows by cosine among the pairs that reach the percentile of all pairs' cosines, with their ranks
    by cosine and by distance among its pairs that reach it; values rounded to 9 digits, ties by b.

    No pair is written. The blocks' products are made three times: for each query's best rows and the counts of cosines in bins, for the exact
    counts in the bins where the percentile lies, and for how many pairs are nearer than the best ones.
    """
    import pandas as pd

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out, bins = [], np.zeros(0, np.int64)
        for a, _, b, c, distances in _blocks(pdf):
            n = np.bincount(((c[c > LEAST] + BILLION) // BIN).astype(np.int64), minlength=len(bins))
            n[: len(bins)] += bins
            bins = n
            least = np.partition(c, -most, axis=1)[:, -most, None] if c.shape[1] > most else LEAST
            at, to = np.nonzero((c >= least) & (c > LEAST))
            order = np.lexsort((to, -c[at, to], at))
            at, to = at[order], to[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < most
            at, to = at[first], to[first]
            out.append(pd.DataFrame({"a": a[at], "b": b[to], "c": c[at, to].astype(np.int64), "d": distances(at, to), "n": 0}))
        at = np.flatnonzero(bins)
        out.append(pd.DataFrame({"a": 0, "b": 0, "c": at, "d": 0.0, "n": bins[at]}))
        return pd.concat([x for x in out if len(x)] or out, ignore_index=True)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0)]
        below = 0
        for _, _, _, c, _ in _blocks(pdf):
            below += int(((c > LEAST) & (c < low)).sum())
            found.append(c[(c >= low) & (c < high)])
        values, n = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"c": [int(LEAST), *values.astype(np.int64)], "n": [below, *n]})

    def nearer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, left, b, c, distances in _blocks(pdf):
            kept = (c > LEAST) & (c / BILLION >= threshold)
            for q, own in enumerate(left["best"]):
                if own is None or not kept[q].any():
                    continue
                to = np.flatnonzero(kept[q])
                d = distances(np.full(len(to), q), to)
                for r in own:
                    out.append((a[q], r["b"], r["rc"], int(((d < r["d"]) | ((d == r["d"]) & (b[to] < r["b"]))).sum())))
        return pd.DataFrame(out, columns=["a", "b", "rc", "n"]).astype("int64")

    first = cut(_dealt(queries, rows).groupBy("i", "j").applyInPandas(best, "a long, b long, c long, d double, n long"))
    bins = sorted((r["c"], r["n"]) for r in first.where("n > 0").groupBy("c").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in bins)
    place = percent / 100 * max(0, total - 1)
    threshold = 0.0
    if total:
        low, high = (_at(bins, int(f(place))) * BIN - BILLION + more for f, more in ((np.floor, 0), (np.ceil, BIN)))
        exact = _dealt(queries, rows).groupBy("i", "j").applyInPandas(counted, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
        counts = sorted(zip(exact["c"].to_pylist(), exact["n"].to_pylist(), strict=True))
        x, y = (_at(counts, int(f(place))) / BILLION for f in (np.floor, np.ceil))
        threshold = UNKNOWN / BILLION if y * BILLION >= UNKNOWN else x + (y - x) * (place - np.floor(place))
    by_c = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    top = first.where("n = 0").withColumn("rc", F.row_number().over(by_c)).where((F.col("rc") <= most) & (F.col("c") / BILLION >= threshold))
    of_query = top.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct("b", "d", "rc")).alias("best"))
    known = _dealt(queries.join(of_query, "id"), rows, ("best",)).groupBy("i", "j").applyInPandas(nearer, "a long, b long, rc long, n long")
    ranks = known.groupBy("a", "b", "rc").agg(F.sum("n").alias("n"))
    # Rows that share both ids and the count take the places behind one another.
    ties = Window.partitionBy("a", "b", "n").orderBy("rc")
    return ranks.select("a", "b", "rc", (F.col("n") + F.row_number().over(ties)).alias("rd"))


def ratio_test(pairs: DataFrame, most: float = 0.75) -> DataFrame:
    """(a, b, d1, d2): the nearest row of every query that is clearly nearer than the second one; ties by id."""
    two = pairs.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where("n <= 2")
    best = two.groupBy("a").agg(F.min_by("b", "n").alias("b"), F.min("d").alias("d1"), F.max("d").alias("d2"))
    return best.where((F.col("d2") > 1e-12) & (F.col("d1") / F.col("d2") < most))
