"""Ranking, fusion and voting over long tables; ties break by id, so results don't depend on row order."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import row_numbers
from .storage import cut


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs with the smaller id first."""
    return pairs.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def with_rank(df: DataFrame, by: list[str], score: str, item: list[str], name: str = "rank", start: int = 1) -> DataFrame:
    """Ranks inside groups of bounded size, such as the partners of one id, by a window."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *item)
    return df.withColumn(name, (F.row_number().over(order) + (start - 1)).cast("long"))


def ranked_lists(lists: DataFrame) -> DataFrame:
    """(list_id, item, score) with the rank from 1 inside each list; lists may be as long as the table."""
    return row_numbers(lists, ["list_id"], "score", ["item"])


def reciprocal_rank_fusion(lists: DataFrame, k: float = 60) -> DataFrame:
    """(item, fused) from (list_id, item, rank): sum of 1 / (k + rank); absent items add nothing."""
    return lists.groupBy("item").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("fused"))


def weighted_rrf(lists: DataFrame, weight: Column, k: float = 60) -> DataFrame:
    """Weighted reciprocal ranks, divided by the largest; the maximum is a one-row aggregate, not a global window."""
    sums = lists.groupBy("item").agg(F.sum(weight / (F.lit(float(k)) + F.col("rank"))).alias("s"))
    top = F.broadcast(sums.agg(F.max("s").alias("m")))
    return sums.crossJoin(top).select("item", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("fused"))


def borda_count(lists: DataFrame) -> DataFrame:
    """Sum over the lists of (length - rank)."""
    sizes = lists.groupBy("list_id").agg(F.count("*").alias("n"))
    return lists.join(sizes, "list_id").groupBy("item").agg(F.sum(F.col("n") - F.col("rank")).alias("points"))


def score_fusion(lists: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean of scores that are min-max scaled per list (1.0 where a list is constant)."""
    span = lists.groupBy("list_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = lists.join(span, "list_id")
    unit = F.when(F.col("hi") - F.col("lo") < 1e-12, 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    total = lists.select("list_id").distinct().agg(F.sum(weight).alias("w"))
    sums = scaled.withColumn("u", unit).groupBy("item").agg(F.sum(weight * F.col("u")).alias("s"))
    return sums.crossJoin(F.broadcast(total)).select("item", (F.col("s") / F.col("w")).alias("fused"))


def pair_votes(votes: DataFrame, min_votes: int = 1) -> DataFrame:
    """(a, b, votes, share): votes of unordered pairs of at least min_votes, and their share of the largest."""
    counted = canonical(votes).groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)
    top = F.broadcast(counted.agg(F.max("votes").alias("m")))
    return counted.crossJoin(top).select("a", "b", "votes", (F.col("votes") / F.col("m")).alias("share"))


def consensus(placed: DataFrame, distance: float = 250.0, share: float = 0.5) -> DataFrame:
    """(a, b, votes): pairs that at least max(1, ceil(share * voters)) voters place nearer than `distance`; a grid finds them."""
    near = distance_join(placed, placed, distance, strict=True, by=["voter"])
    need = F.broadcast(placed.agg(F.greatest(F.lit(1), F.ceil(share * F.count_distinct("voter"))).alias("need")))
    pairs = near.where("a < b").groupBy("a", "b").agg(F.count_distinct("voter").alias("votes"))
    return pairs.crossJoin(need).where("votes >= need").drop("need")


def _square(x: Column) -> Column:
    return x * x


def _cells(radius: float) -> Callable[[str], Column]:
    """Grid cells of half the radius, a hair wider, so that no rounding parts points within the radius by more than two cells."""
    return lambda c: F.floor(F.col(c) / (radius / 2 * (1 + 1e-9))).cast("long")


def distance_join(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, by: list[str] | None = None, same: bool = False) -> DataFrame:
    """(a, b, d) of points (id, x, y) within `radius`, other ids only unless `same`: an equi-join on grid cells, then the exact distance.

    The left points go out to the cells around them. They meet the right ones by a merge join, as the size of a table that was dealt out so is
    underrated, and a broadcast would fill the driver and leave the work to the few tasks of the other side.
    """
    by, cell, around = by or [], _cells(radius), range(-2, 3)
    x = left.select(*by, F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), cell("x").alias("gx"), cell("y").alias("gy"))
    for to, at in (("cx", "gx"), ("cy", "gy")):
        x = x.withColumn(to, F.explode(F.array(*[F.col(at) + i for i in around]))).drop(at)
    y = right.select(*by, F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(_square(F.col("xa") - F.col("xb")) + _square(F.col("ya") - F.col("yb")))
    found = x.join(y.hint("merge"), [*by, "cx", "cy"]).where(F.lit(same) | (F.col("a") != F.col("b"))).withColumn("d", d)
    return found.where(F.col("d") < radius if strict else F.col("d") <= radius).select(*by, "a", "b", "d")


def near_pairs(points: DataFrame, radius: float, strict: bool = False, carry: Iterable[str] = ()) -> DataFrame:
    """(a, b, d) with a < b of points (id, x, y) within `radius`, each two rows once, and columns c1, c2 for every carried c.

    Cells meet only those ahead of them, so which end is 1 and which is 2 is open: carried columns are for what is the same both ways.
    """
    cell, ahead = _cells(radius), [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) >= (0, 0)]
    side = lambda k: points.select(F.col("id").alias("id" + k), F.col("x").alias("x_" + k), F.col("y").alias("y_" + k), *[F.col(c).alias(c + k) for c in carry], cell("x").alias("cx"), cell("y").alias("cy"))
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead]))
    x = side("1").withColumn("o", to).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "own": (F.col("o.i") == 0) & (F.col("o.j") == 0)}).drop("o")
    d = F.sqrt(_square(F.col("x_1") - F.col("x_2")) + _square(F.col("y_1") - F.col("y_2")))
    found = x.join(side("2").hint("merge"), ["cx", "cy"]).where(F.when(F.col("own"), F.col("id1") < F.col("id2")).otherwise(F.col("id1") != F.col("id2"))).withColumn("d", d)
    kept = found.where(F.col("d") < radius if strict else F.col("d") <= radius)
    return kept.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "d", *[c + k for c in carry for k in "12"])


def dedup_keep_best(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair, the one of the largest score."""
    return canonical(pairs).groupBy("a", "b").agg(F.max("score").alias("score"))


def top_k_both_ends(pairs: DataFrame, k: int) -> DataFrame:
    """(id, other, score, rank): each end's k best partners, capped independently."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score")
    both = both.union(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    return with_rank(both, ["id"], "score", ["other"]).where(F.col("rank") <= k)


def rank_pairs(pairs: DataFrame, least: float, top: int = 0, start: int = 1) -> DataFrame:
    """Deduplicated pairs of at least `least`, ranked from `start`; top bounds the rows before they are numbered, 0 leaves all."""
    best = dedup_keep_best(pairs).where(F.col("score") >= least)
    if top:
        return with_rank(best.orderBy(F.desc("score"), "a", "b").limit(top), [], "score", ["a", "b"], start=start)  # `top` rows
    return row_numbers(best, [], "score", ["a", "b"], start=start)


def endpoint_means(pairs: DataFrame) -> DataFrame:
    """(id, mean_score) over the pairs of each end."""
    both = pairs.select(F.col("a").alias("id"), "score").union(pairs.select(F.col("b").alias("id"), "score"))
    return both.groupBy("id").agg(F.avg("score").alias("mean_score"))


def aggregate_channels(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(a, b, score) from cells (a, b, channel, score) off the diagonal: min-max per channel (0 if constant), both directions averaged.

    A channel without a weight counts 0; the divisor is the sum of the weights of the channels that are there, 1 if that is 0.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel")), F.lit(0.0))
    cells = scores.where("a <> b")
    span = cells.groupBy("channel").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).withColumn("w", weight)
    total = span.agg(F.sum("w").alias("t")).select(F.when(F.col("t") < 1e-12, 1.0).otherwise(F.col("t")).alias("t"))
    unit = F.when(F.col("hi") - F.col("lo") < 1e-12, 0.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    rows = cells.join(span, "channel").withColumn("u", unit * F.col("w"))
    return canonical(rows).groupBy("a", "b").agg(F.sum("u").alias("u")).crossJoin(F.broadcast(total)).select("a", "b", (F.col("u") / F.col("t") / 2).alias("score"))


def greedy_matching(pairs: DataFrame, by: list[str], cap: int = 1, few: int = 100_000, rounds: int = 40) -> DataFrame:
    """Pairs (by..., a, b, score) taken in order of score, then ids, while both ends have fewer than `cap`.

    A pair that is among the best `left` open pairs of both its ends, where `left` is what the end may still take, is taken whatever
    happens elsewhere. So all such pairs are taken at once, round by round, with joins and windows over one end's pairs. What
    remains open after them, at most `few` rows a group, is taken in order by one task a group; `rounds` is where it is looked whether it may.
    """
    keys = [*by, "a", "b"]
    open_ = cut(pairs.select(*by, "a", "b", "score"))
    had = None  # (by..., id, n): what each end has taken so far
    taken: list[DataFrame] = []
    for n in itertools.count(1):
        ends = open_.select(*by, F.col("a").alias("id"), *[F.col(c) for c in ("a", "b", "score")]).union(open_.select(*by, F.col("b").alias("id"), "a", "b", "score"))
        best = Window.partitionBy(*by, "id").orderBy(F.desc("score"), "a", "b")
        ranked = ends.withColumn("r", F.row_number().over(best)).where(F.col("r") <= cap)
        if had is not None:
            ranked = ranked.join(had, [*by, "id"], "left").where(F.col("r") <= cap - F.coalesce("n", F.lit(0)))
        now = cut(ranked.groupBy(*keys).agg(F.count("*").alias("k"), F.first("score").alias("score")).where("k = 2").drop("k"))
        taken.append(now)
        used = now.select(*by, F.col("a").alias("id")).union(now.select(*by, F.col("b").alias("id")))
        used = used.groupBy(*by, "id").agg(F.count("*").alias("n"))
        had = cut(used if had is None else used.union(had).groupBy(*by, "id").agg(F.sum("n").alias("n")))
        full = had.where(F.col("n") >= cap).drop("n")
        open_ = open_.join(now.drop("score"), keys, "left_anti")
        for end in ("a", "b"):
            open_ = open_.join(full.withColumnRenamed("id", end), [*by, end], "left_anti")
        open_ = cut(open_.select(*by, "a", "b", "score"))
        most = open_.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if not most or most <= few:
            break
        if n >= rounds and most <= 10 * few:
            break
    chosen = reduce(DataFrame.unionByName, taken)
    if most:
        chosen = chosen.unionByName(_taken_in_order(open_, had, by, cap))
    return pairs.join(chosen.select(*keys), keys, "left_semi").select(*pairs.columns)


def _taken_in_order(pairs: DataFrame, had: DataFrame, by: list[str], cap: int) -> DataFrame:
    """The rest of a greedy matching: few pairs, one after another."""
    import pandas as pd

    start = had.withColumnRenamed("id", "a").withColumnRenamed("n", "n_a"), had.withColumnRenamed("id", "b").withColumnRenamed("n", "n_b")
    rows = pairs.join(start[0], [*by, "a"], "left").join(start[1], [*by, "b"], "left").select(*pairs.columns, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))

    columns = pairs.columns

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "a", "b"], ascending=[False, True, True])
        used = dict(zip(pdf["a"], pdf["n_a"], strict=True)) | dict(zip(pdf["b"], pdf["n_b"], strict=True))
        keep = []
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ok = used[a] < cap and used[b] < cap
            used[a] += ok
            used[b] += ok
            keep.append(ok)
        return pdf.loc[keep, columns]

    return rows.groupBy(*by).applyInPandas(take, pairs.schema)


def capped_per_fragment(pairs: DataFrame, cap: int) -> DataFrame:
    """Pairs (a, b, score) in order of score while both fragments have fewer than `cap`."""
    return greedy_matching(pairs.withColumn("_one", F.lit(0)), ["_one"], cap).drop("_one")


def filter_pairs(pairs: DataFrame, least: float = 0.0, inliers: int = 0, cap: int = 5, most: int = 100) -> DataFrame:
    """(a, b, score, n_inliers): by score, by inliers, the best of each unordered pair, `cap` per fragment if there are more than `cap`, the best `most`."""
    good = canonical(pairs.where((F.col("score") >= least) & (F.col("n_inliers") >= inliers)))
    best = good.groupBy("a", "b").agg(F.max(F.struct("score", "n_inliers")).alias("m")).select("a", "b", "m.score", "m.n_inliers")
    if len(best.take(cap + 1)) > cap:
        best = capped_per_fragment(best, cap)
    return best.orderBy(F.desc("score"), "a", "b").limit(most)
