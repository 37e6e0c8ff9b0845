"""Score normalisation and threshold selection: one-row aggregates joined back, never windows over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import _bucketed, percentiles, row_numbers


def _with_totals(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    totals = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])
    return df.join(totals, by) if by else df.crossJoin(F.broadcast(totals))


def minmax(df: DataFrame, score: str, degenerate: float | None = None, by: list[str] | None = None, name: str = "normed", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scores moved to [low, high]; a constant group gets `degenerate`, `low` unless told otherwise."""
    rows = _with_totals(df, by or [], lo_=F.min(score), hi_=F.max(score))
    span = F.col("hi_") - F.col("lo_")
    unit = F.lit(low) + (F.col(score) - F.col("lo_")) / span * (high - low)
    return rows.withColumn(name, F.when(span < 1e-12, F.lit(low if degenerate is None else degenerate)).otherwise(unit)).drop("lo_", "hi_")


def zscore(df: DataFrame, score: str, clip: float = 3.0, name: str = "normed") -> DataFrame:
    """Population z-score, clipped and rescaled to [0, 1]; 0.5 where all are equal."""
    rows = _with_totals(df, [], mean_=F.avg(score), std_=F.stddev_pop(score))
    # greatest and least skip nulls, so the constant case is told apart outside them.
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(F.col(score) - F.col("mean_"), F.col("std_"))))
    return rows.withColumn(name, F.when(F.col("std_") > 1e-12, (z + clip) / (2 * clip)).otherwise(F.lit(0.5))).drop("mean_", "std_")


def softmax(df: DataFrame, score: str, by: list[str], temperature: float = 1.0, name: str = "normed") -> DataFrame:
    """Over the rows (by) of a matrix, its columns, or without `by` over all cells."""
    rows = _with_totals(df, by, top_=F.max(score)).withColumn("e_", F.exp((F.col(score) - F.col("top_")) / temperature))
    return _with_totals(rows, by, sum_=F.sum("e_")).withColumn(name, F.col("e_") / F.col("sum_")).drop("top_", "e_", "sum_")


def matrix_minmax(df: DataFrame, score: str, name: str = "normed") -> DataFrame:
    """All cells to [0, 1]; 0 where all are equal."""
    return minmax(df, score, 0.0, name=name)


def matrix_zscore(df: DataFrame, score: str, name: str = "normed") -> DataFrame:
    """Population z-score over all cells; 0 where all are equal."""
    rows = _with_totals(df, [], mean_=F.avg(score), std_=F.stddev_pop(score))
    return rows.withColumn(name, F.when(F.col("std_") < 1e-12, 0.0).otherwise((F.col(score) - F.col("mean_")) / F.col("std_"))).drop("mean_", "std_")


def row_normalise(df: DataFrame, score: str, by: list[str], how: str = "sum", name: str = "normed") -> DataFrame:
    """how: sum, max, l1 (sum of absolute values), l2 or minmax; rows whose divisor is 0 are 0."""
    if how == "minmax":
        return minmax(df, score, 0.0, by, name)
    total = {"sum": F.sum(score), "max": F.max(score), "l1": F.sum(F.abs(score)), "l2": F.sqrt(F.sum(F.col(score) ** 2))}[how]
    rows = _with_totals(df, by, t_=total)
    return rows.withColumn(name, F.when(F.abs("t_") < 1e-12, 0.0).otherwise(F.col(score) / F.col("t_"))).drop("t_")


def calibrated(df: DataFrame, score: str, reference: DataFrame, target: str, name: str = "calibrated") -> DataFrame:
    """Scores replaced by the reference's value at the same quantile: place floor(share of scores <= x times (m - 1)) of its order.

    Both distributions are counted by value first; ranks are made in buckets of values.
    """
    own = df.groupBy(F.col(score).alias("s_")).agg(F.count("*").alias("c_"))
    own = _counted_upto(own, "s_", "c_")
    n, m = (F.broadcast(x.agg(F.count("*").alias(k))) for x, k in ((df, "n_"), (reference, "m_")))
    places = own.crossJoin(n).crossJoin(m).withColumn("at_", F.floor(F.col("upto_") / F.col("n_") * (F.col("m_") - 1)).cast("long"))
    values = row_numbers(reference.select(F.col(target).alias(name)), [], name, [], "at_", 0, descending=False)
    return df.join(places.select("s_", "at_"), F.col(score) == F.col("s_")).join(values, "at_").select(*df.columns, name)


def _counted_upto(counts: DataFrame, value: str, count: str) -> DataFrame:
    """counts(value, count) with `upto_`: the sum of counts up to the value."""
    rows = _bucketed(counts, [], value)
    sums = rows.groupBy("bucket_").agg(F.sum(count).alias("n_"))
    before = sums.select("bucket_", F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))  # a row per bucket
    up = Window.partitionBy("bucket_").orderBy(value)
    return rows.join(before, "bucket_").withColumn("upto_", F.col("before_") + F.sum(count).over(up)).drop("bucket_", "before_")


def percentile_threshold(df: DataFrame, score: str, percent: float) -> DataFrame:
    return percentiles(df, [], score, {"threshold": percent / 100})


def adaptive(df: DataFrame, score: str) -> DataFrame:
    """(threshold): the mean of the median and Otsu's threshold."""
    half = percentile_threshold(df, score, 50).withColumnRenamed("threshold", "half")
    return otsu(df, score).crossJoin(F.broadcast(half)).select(((F.col("threshold") + F.col("half")) / 2).alias("threshold"))


def otsu(df: DataFrame, score: str, bins: int = 256) -> DataFrame:
    """(threshold): right edge of the middle bin of the plateau of the largest between-class variance."""
    span = F.broadcast(df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")))
    at = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = df.where(F.col(score).isNotNull()).crossJoin(span).where("hi > lo").withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(span)
    hist = spine.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    up = Window.orderBy("bin")  # `bins` rows
    all_ = Window.partitionBy()
    cum = hist.withColumn("m", mid * F.col("n")).select("bin", "lo", "hi", F.sum("n").over(up).alias("w1"), F.sum("m").over(up).alias("s1"), F.sum("n").over(all_).alias("w"), F.sum("m").over(all_).alias("s"))
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / (F.col("w") - F.col("w1"))
    var = F.when((F.col("w1") > 0) & (F.col("w") > F.col("w1")), F.col("w1") * (F.col("w") - F.col("w1")) * gap * gap).otherwise(0.0)
    best = cum.withColumn("v", var).withColumn("top", F.max("v").over(all_)).where(F.col("v") >= F.col("top") * (1 - 1e-10))
    middle = best.groupBy("lo", "hi").agg(F.sort_array(F.collect_list("bin")).alias("b"))
    edge = F.col("lo") + (F.element_at("b", (F.size("b") / 2).cast("int") + 1) + 1) * (F.col("hi") - F.col("lo")) / bins
    return span.join(middle, ["lo", "hi"], "left").select(F.when(F.col("hi") > F.col("lo"), edge).otherwise(F.col("lo")).alias("threshold"))


def fbeta_sweep(df: DataFrame, score: str, label: str, beta: float = 1.0, steps: int = 50) -> DataFrame:
    """(threshold, fbeta): the first best of `steps` evenly spaced thresholds; each score is counted at the last threshold that it reaches."""
    span = F.broadcast(df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")))
    threshold = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (steps - 1)
    about = F.coalesce(F.floor(F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo")) * (steps - 1)), F.lit(steps - 1)).cast("long")
    # The division may round to the wrong side of a threshold; the comparison itself decides.
    step = F.when(F.col(score) < threshold(about), about - 1).when((about < steps - 1) & (F.col(score) >= threshold(about + 1)), about + 1).otherwise(about)
    counts = df.crossJoin(span).groupBy(step.alias("id")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    grid = df.sparkSession.range(steps).crossJoin(span).join(counts, "id", "left").select("id", threshold(F.col("id")).alias("threshold"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    above = Window.orderBy("id").rowsBetween(0, Window.unboundedFollowing)  # `steps` rows
    sums = grid.select("id", "threshold", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("said"), F.sum("p").over(Window.partitionBy()).alias("is"))
    b2 = beta * beta
    scored = sums.withColumn("fbeta", F.coalesce(F.try_divide((1 + b2) * F.col("tp"), b2 * F.col("is") + F.col("said")), F.lit(0.0)))
    return scored.agg(F.max_by("threshold", F.struct("fbeta", -F.col("id"))).alias("threshold"), F.max("fbeta").alias("fbeta"))
