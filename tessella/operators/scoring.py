"""Combining channel scores, cost matrices, histogram and layout scores, schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import row_numbers
from .thresholds import _with_totals, minmax


def _weight(channel: str, weights: dict[str, float], missing: float) -> Column:
    out = F.lit(missing)
    for name, w in weights.items():
        out = F.when(F.col(channel) == name, w).otherwise(out)
    return out


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: greatest and least would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def strategies(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each pair's channels by every strategy, clipped to [0, 1]; a channel without a weight counts 1.

    The rank strategy is the mean of the channels' ranks by their number, (n + 1) / 2n whatever the scores.
    """
    floored, w, n = F.greatest("score", F.lit(1e-9)), _weight("channel", weights or {}, 1.0), F.count("score")
    return scores.groupBy("a", "b").agg(
        clip(F.sum(w * F.col("score")) / (F.sum(w) + 1e-12)).alias("weighted"), clip(F.avg("score")).alias("mean"), clip(F.min("score")).alias("low"), clip(F.max("score")).alias("high"),
        clip(F.median("score")).alias("median"), clip(F.product("score")).alias("product"), ((n + 1) / (2 * n)).alias("rank"),
        clip(n / F.sum(1 / floored)).alias("harmonic"), clip(F.exp(F.avg(F.log(floored)))).alias("geometric"),
    )


def weighted_combine(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Clipped weighted mean of the channels; a channel without a weight counts 1."""
    w = _weight("channel", weights, 1.0)
    return scores.groupBy("a", "b").agg(clip(F.sum(w * F.col("score")) / F.sum(w)).alias("score"))


def match_score(scores: DataFrame, weights: dict[str, float], confident: float = 0.7) -> DataFrame:
    """Weighted mean of clipped scores; a channel without a weight counts 0."""
    w = _weight("channel", weights, 0.0)
    total = F.sum(w * clip(F.col("score"))) / (F.sum(w) + 1e-12)
    return scores.groupBy("a", "b").agg(total.alias("score")).withColumn("confident", F.col("score") >= confident)


def evidence(scores: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """Scores below `least` add 0, but their weights still count."""
    w = _weight("channel", weights, 1.0)
    used = F.when(F.col("score") >= least, F.col("score")).otherwise(0.0)
    return scores.groupBy("a", "b").agg((F.sum(w * used) / F.sum(w)).alias("evidence"), F.sum((F.col("score") >= least).cast("long")).alias("n_used"))


def rank_combine(scores: DataFrame) -> DataFrame:
    """1 - mean descending rank / (n - 1) over the channels; ties go by the pair; one pair alone has 1."""
    ranked = row_numbers(scores, ["channel"], "score", ["a", "b"], "r", 0)
    n = scores.groupBy("channel").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") > 1, F.col("r") / (F.col("n") - 1)).otherwise(0.0)
    return ranked.join(n, "channel").groupBy("a", "b").agg((1 - F.avg(share)).alias("score"))


def rank_in_rows(df: DataFrame, score: str, by: list[str], item: list[str], name: str = "normed") -> DataFrame:
    """Ascending rank / (n - 1) inside each row of a matrix; 0 for a row of one, 0.5 for a constant one."""
    up, row = Window.partitionBy(*by).orderBy(score, *item), Window.partitionBy(*by)
    n, flat = F.count("*").over(row), F.max(score).over(row) - F.min(score).over(row) < 1e-12
    return df.withColumn(name, F.when(n <= 1, 0.0).when(flat, 0.5).otherwise((F.row_number().over(up) - 1) / (n - 1)))


def sigmoid(x: Column, slope: float = 1.0, centre: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-slope * (x - centre)))


def costs(scores: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(a, b, cost): 1 - min-max over all cells, 0 on the diagonal."""
    rows = _with_totals(scores, [], lo_=F.min("score"), hi_=F.max("score"))
    cost = 1 - (F.col("score") - F.col("lo_")) / (F.col("hi_") - F.col("lo_") + eps)
    return rows.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(cost).alias("cost"))


def combined_costs(costs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(a, b, cost) of several matrices (name, a, b, cost): their sum by weights that are scaled to 1; 0 on the diagonal."""
    share = _weight("name", weights, 0.0) / sum(weights.values())
    return costs.groupBy("a", "b").agg(F.sum(share * F.col("cost")).alias("cost")).withColumn("cost", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("cost")))


def normalised_costs(cost: DataFrame, how: str = "minmax") -> DataFrame:
    """(a, b, cost) by the cells off the diagonal; how: minmax, zscore (below 0 cut, then by the largest) or rank (ties by cell)."""
    off = cost.where("a <> b").select("a", "b", "cost")
    if how == "minmax":
        return minmax(off, "cost", 0.0, name="normed").select("a", "b", F.col("normed").alias("cost"))
    if how == "zscore":
        rows = _with_totals(off, [], mean_=F.avg("cost"), std_=F.stddev_pop("cost"))
        z = F.when(F.col("std_") > 1e-12, (F.col("cost") - F.col("mean_")) / F.col("std_")).otherwise(F.col("cost"))
        rows = _with_totals(rows.select("a", "b", F.greatest(F.lit(0.0), z).alias("cost")), [], top_=F.max("cost"))
        return rows.select("a", "b", F.when(F.col("top_") > 1e-12, F.col("cost") / F.col("top_")).otherwise(F.col("cost")).alias("cost"))
    ranked = _with_totals(row_numbers(off, [], "cost", ["a", "b"], "r_", 0, descending=False), [], n_=F.count("*"))
    return ranked.select("a", "b", (F.col("r_") / F.greatest(F.lit(1), F.col("n_") - 1)).alias("cost"))


def cheapest(cost: DataFrame, k: int) -> DataFrame:
    """The k cheapest others of every row."""
    up = Window.partitionBy("a").orderBy("cost", "b")
    return cost.where("a <> b").withColumn("rank", F.row_number().over(up).cast("long")).where(F.col("rank") <= k)


def best_per_row(scores: DataFrame, k: int) -> DataFrame:
    """The k best others of every row of a matrix, only those above 0."""
    down = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scores.where("a <> b and score > 0").withColumn("rank", F.row_number().over(down).cast("long")).where(F.col("rank") <= k)


def channel_means(scores: DataFrame, weights: dict[str, float] | None = None, symmetric: bool = True) -> DataFrame:
    """(a, b, score) of unordered pairs: both directions of a channel averaged (else the one from the smaller id), then the channels' weighted mean, clipped.

    Channels are summed in the order of the weights, then of their names, so that a half of a later rounding's last digit does not hang on
    the order of rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    first = F.max(F.when(F.col("a") <= F.col("b"), F.col("score")))
    each = F.avg("score") if symmetric else F.coalesce(first, F.max("score"))
    pair = scores.where("a <> b").groupBy("channel", low.alias("a"), high.alias("b")).agg(each.alias("score"))
    w = _weight("channel", weights or {}, 1.0)
    place = F.coalesce(F.nullif(F.array_position(F.lit(list(weights)), F.col("channel")), F.lit(0)), F.lit(len(weights) + 1)) if weights else F.lit(0)
    listed = pair.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "channel", w.alias("w"), "score"))).alias("l"))
    total = lambda each: F.aggregate("l", F.lit(0.0), lambda s, x: s + each(x))
    return listed.select("a", "b", clip(F.coalesce(F.try_divide(total(lambda x: x["w"] * x["score"]), total(lambda x: x["w"])), F.lit(0.0))).alias("score"))


def candidates(pairs: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(id, candidate, score, rank) of pairs(a, b, score): the k best partners of every id that reach `least`; equal scores go by id."""
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("candidate"), "score").union(pairs.select("b", "a", "score"))
    down = Window.partitionBy("id").orderBy(F.desc("score"), "candidate")
    return ends.where(F.col("score") >= least).withColumn("rank", F.row_number().over(down).cast("long")).where(F.col("rank") <= k)


def merged_candidates(results: list[DataFrame], k: int) -> DataFrame:
    """Several results of `candidates` in one: the mean of a candidate's scores, cut to k and ranked anew.

    Means are rounded to 12 digits, so that ties don't hang on the order of a sum.
    """
    every = reduce(DataFrame.unionByName, [r.select("id", "candidate", "score") for r in results])
    mean = every.groupBy("id", "candidate").agg(F.round(F.avg("score"), 12).alias("score"))
    down = Window.partitionBy("id").orderBy(F.desc("score"), "candidate")
    return mean.withColumn("rank", F.row_number().over(down).cast("long")).where(F.col("rank") <= k)


def sparsity(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: share of exact zeros among the stored cells, and 1 - share of off-diagonal cells above the threshold."""
    ends = scores.select(F.explode(F.array("a", "b")).alias("x")).agg(F.count_distinct("x").alias("n"))
    cells = scores.agg(F.avg((F.col("score") == 0).cast("int")).alias("zeros"), F.sum(((F.col("score") > threshold) & (F.col("a") != F.col("b"))).cast("long")).alias("above"))
    return cells.crossJoin(ends).select("zeros", (1 - F.col("above") / (F.col("n") * (F.col("n") - 1))).alias("sparsity"))


def histogram_distances(hist: DataFrame, bins: int) -> DataFrame:
    """(x, y, chi2, emd, shared) between the normalised histograms(name, bin, n) of every two names; names are few."""
    total = hist.groupBy("name").agg(F.sum("n").alias("t"))
    spine = total.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = spine.join(hist, ["name", "bin"], "left").select("name", "bin", (F.coalesce("n", F.lit(0)) / F.col("t")).alias("p"))
    full = full.withColumn("c", F.sum("p").over(Window.partitionBy("name").orderBy("bin")))
    x, y = (full.select(F.col("name").alias(k), "bin", F.col("p").alias(f"p{k}"), F.col("c").alias(f"c{k}")) for k in ("x", "y"))
    both = x.join(y, "bin").where("x < y")
    chi = (F.col("px") - F.col("py")) ** 2 / (F.col("px") + F.col("py") + 1e-12)
    return both.groupBy("x", "y").agg((F.sum(chi) / 2).alias("chi2"), F.sum(F.abs(F.col("cx") - F.col("cy"))).alias("emd"), (F.sum(F.least("px", "py")) / F.sum("py")).alias("shared"))


def zone_of(value: Column, most: float, n: int) -> Column:
    """Cut towards 0, then to the grid's rim."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), (value / most * n).cast("int"))).cast("long")


def zones(places: DataFrame, width: float, height: float, columns: int, rows: int) -> DataFrame:
    """(zone_x, zone_y, n, mean_score) of places(x, y, score) cut to a grid; places outside go to its rim."""
    at = places.select(zone_of(F.col("x"), width, columns).alias("zone_x"), zone_of(F.col("y"), height, rows).alias("zone_y"), "score")
    return at.groupBy("zone_x", "zone_y").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def mapping_score(zoned: DataFrame, columns: int, rows: int) -> DataFrame:
    """(score) of zones(zone_x, zone_y, n, mean_score): mean score of all places times the share of zones that hold any."""
    sums = zoned.agg(F.sum(F.col("n") * F.col("mean_score")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("used"))
    return sums.select(F.coalesce(clip(F.try_divide(F.col("s"), F.col("n")) * F.col("used") / (columns * rows)), F.lit(0.0)).alias("score"))


def placement_accuracy(found: DataFrame, truth: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """One row: share of the true places(id, x, y) found within the tolerance; a missing place is wrong."""
    f = found.select("id", F.col("x").alias("fx"), F.col("y").alias("fy"))
    near = F.sqrt((F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2) <= tolerance
    return truth.join(f, "id", "left").agg(F.coalesce(F.avg(F.coalesce(near, F.lit(False)).cast("int")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def boundary_quality(flaws: DataFrame, checked: DataFrame, by: list[str], decay: float = 1.0) -> DataFrame:
    """(by..., quality): exp(-decay * severities / pairs checked); checked has n_pairs for every group, flaws a severity per violation."""
    total = flaws.groupBy(*by).agg(F.sum("severity").alias("s_"))
    rows = checked.join(total, by, "left")
    return rows.select(*by, F.exp(-decay * F.coalesce("s_", F.lit(0.0)) / F.col("n_pairs")).alias("quality"))


def feature_ranking(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, strength, rank): absolute correlation with the target, 0 for constant columns; one pass over the rows."""
    one = rows.agg(*[F.coalesce(F.abs(F.corr(f, target)), F.lit(0.0)).alias(f) for f in features])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("strength")) for f in features])).alias("s")).select("s.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "feature")).cast("long"))  # one row a feature


def correlated_features(rows: DataFrame, features: list[str], most: float = 0.95) -> DataFrame:
    """(feature, kept): from left to right, a feature goes if its correlation with one kept before is above `most`.

    Correlations are population covariances by n - 1, as the definition has them; constant columns have none. One pass over the rows.
    """
    n = F.count("*")
    inflated = lambda a, b: F.coalesce(F.corr(a, b) * n / F.greatest(F.lit(1), n - 1), F.lit(0.0))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    r = dict(zip(pairs, rows.agg(*[inflated(a, b) for a, b in pairs]).first(), strict=True)) if pairs else {}
    kept: list[str] = []
    for f in features:
        if all(abs(max(-1.0, min(1.0, r[k, f]))) <= most for k in kept):
            kept.append(f)
    return rows.sparkSession.createDataFrame([(f, f in kept) for f in features], "feature string, kept boolean")


def normalised_features(rows: DataFrame, features: list[str]) -> DataFrame:
    """Columns to zero mean and unit population deviation; a constant column is only centred."""
    totals = {f"{f}_mean": F.avg(f) for f in features} | {f"{f}_std": F.stddev_pop(f) for f in features}
    sized = _with_totals(rows, [], **totals)
    unit = {f: (F.col(f) - F.col(f"{f}_mean")) / F.when(F.col(f"{f}_std") < 1e-12, 1.0).otherwise(F.col(f"{f}_std")) for f in features}
    return sized.withColumns(unit).drop(*totals)


def fill_gaps(df: DataFrame) -> DataFrame:
    """series(series, step, value) with `filled`: nulls and NaN linear inside, the nearest value at the ends, 0 where there is none."""
    by = Window.partitionBy("series").orderBy("step")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    own = F.when(~F.isnan("value"), F.col("value"))
    at = F.when(own.isNotNull(), F.col("step"))
    seen = df.select("*", F.last(own, True).over(back).alias("v0"), F.last(at, True).over(back).alias("s0"), F.first(own, True).over(ahead).alias("v1"), F.first(at, True).over(ahead).alias("s1"))
    inside = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("step") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    filled = F.coalesce(own, F.when(F.col("v0").isNotNull() & F.col("v1").isNotNull(), inside), "v0", "v1", F.lit(0.0))
    return seen.select(*df.columns, filled.alias("filled"))


def finite_mean(value: Column) -> Column:
    """Mean that skips nulls, NaN and infinities; 0 without any finite value."""
    return F.coalesce(F.avg(F.when(F.abs(value) < float("inf"), value)), F.lit(0.0))


def schedule(spark: SparkSession, shape: str, start: float, end: float, steps: int, rate: float = 0.95, width: int = 10) -> DataFrame:
    """(step, temperature), never below `end`: linear, geometric (by `rate`), exponential, cosine or stepped (plateaus of `width`)."""
    k, t = F.col("id"), F.col("id") / max(1, steps - 1)
    plateaus = max(1, -(-steps // width))
    value = {
        "linear": start - (start - end) * t,
        "geometric": start * F.pow(F.lit(rate), k),
        "exponential": start * F.pow(F.lit(end / start), t),
        "cosine": end + (start - end) * (1 + F.cos(t * 3.141592653589793)) / 2,
        "stepped": start - (start - end) * F.least(F.lit(1.0), F.floor(k / width) / max(1, plateaus - 1)),
    }[shape]
    return spark.range(steps).select(k.alias("step"), F.greatest(F.lit(end), value).alias("temperature"))


def steps_to(start: Column, target: Column, rate: Column) -> Column:
    """Steps of a geometric schedule until it reaches the target: ceil(ln(target / start) / ln(rate)), at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.log(target / start) / F.log(rate))).cast("long")


def wrapped(angle: Column) -> Column:
    """The angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(6.283185307179586))


def nearest_angle(angle: Column, angles: list[float]) -> Column:
    """The candidate with the shortest arc to the angle, the first of equally near ones."""
    rated = F.array(*[F.struct(shortest_arc(angle, F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(angles)])
    return F.array_min(rated)["c"]


def angle_agreement(rows: DataFrame, by: list[str], angle: str, tolerance: float = 5.0) -> DataFrame:
    """(by..., agreement): share of a group's pairs whose angles differ by at most the tolerance, not around the circle; 1 for a single row.

    Angles are counted by value, and a pair is looked up through a sorted window, not formed.
    """
    counts = rows.groupBy(*by, F.col(angle).cast("double").alias("x")).agg(F.count("*").alias("c"))
    groups = f"partition by {', '.join(f'`{c}`' for c in by)} " if by else ""
    near = counts.withColumn("m", F.expr(f"sum(c) over ({groups}order by x range between current row and {float(tolerance)!r}D following)"))
    agree = F.sum(F.col("c") * (F.col("c") - 1) / 2 + F.col("c") * (F.col("m") - F.col("c")))
    sums = near.groupBy(*by).agg(agree.alias("agree"), F.sum("c").alias("n"))
    return sums.select(*by, F.when(F.col("n") <= 1, 1.0).otherwise(F.col("agree") / (F.col("n") * (F.col("n") - 1) / 2)).alias("agreement"))


def specified_levels(source: DataFrame, target: DataFrame, levels: int = 256) -> DataFrame:
    """(level, mapped): a level goes to the first one whose cumulative share in the target reaches its own in the source (level, n)."""
    spine = source.sparkSession.range(levels).select(F.col("id").alias("level"))
    up = Window.orderBy("level")  # `levels` rows

    def shares(hist: DataFrame, name: str) -> DataFrame:
        full = spine.join(hist, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
        return full.select(F.col("level").alias(name), (F.sum("n").over(up) / (F.sum("n").over(Window.partitionBy()) + 1e-12)).alias(f"{name}_share"))

    met = shares(source, "level").join(F.broadcast(shares(target, "to")), F.col("to_share") >= F.col("level_share"), "left")  # levels x levels
    return met.groupBy("level").agg(F.coalesce(F.min("to"), F.lit(levels - 1)).alias("mapped"))


def report(entries: DataFrame, by: list[str], weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """(by..., total, n_metrics, passed) of entries(metric, value, weight): given weights go before the entry's own."""
    w = F.coalesce(_weight("metric", weights, -1.0), F.lit(-1.0))
    w = F.when(w >= 0, w).otherwise(F.col("weight"))
    sums = entries.groupBy(*by).agg(clip(F.sum(w * F.col("value")) / (F.sum(w) + 1e-12)).alias("total"), F.count("*").alias("n_metrics"))
    return sums.withColumn("passed", F.col("total") >= threshold)


def shortest_arc(a: Column, b: Column) -> Column:
    """Smaller angle in radians between two directions."""
    turn = 6.283185307179586
    d = F.pmod(a - b, F.lit(turn))
    return F.least(d, turn - d)
