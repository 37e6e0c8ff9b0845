"""Windows, smoothing, islands and summaries over (series, step, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import percentiles


def _w(order: str = "step") -> Window:
    return Window.partitionBy("series").orderBy(order)


def trailing_mean(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("trailing", F.avg("value").over(_w().rowsBetween(1 - size, 0)))


def sliding_mean(df: DataFrame, size: int) -> DataFrame:
    """Centred frame of size // 2 to either side, shrinking at the ends."""
    return df.withColumn("sliding", F.avg("value").over(_w().rowsBetween(-(size // 2), size // 2)))


def edge_padded_mean(df: DataFrame, size: int) -> DataFrame:
    """Centred mean of an odd size with the end values repeated outside."""
    r = size // 2
    whole = Window.partitionBy("series").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumns({"n": F.count("*").over(whole), "k": F.row_number().over(_w()), "first": F.first("value").over(whole), "last": F.last("value").over(whole)})
    inner = F.sum("value").over(_w().rowsBetween(-r, r))
    before, after = F.greatest(F.lit(0), r - F.col("k") + 1), F.greatest(F.lit(0), F.col("k") + r - F.col("n"))
    return rows.withColumn("smooth", (inner + before * F.col("first") + after * F.col("last")) / size).drop("n", "k", "first", "last")


def edge_padded_median(df: DataFrame, size: int) -> DataFrame:
    """Centred median of an odd size with the end values repeated outside."""
    r = size // 2
    whole = _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumns({"n": F.count("*").over(whole), "k": F.row_number().over(_w()), "first": F.first("value").over(whole), "last": F.last("value").over(whole), "near": F.collect_list("value").over(_w().rowsBetween(-r, r))})
    outside = lambda c, n: F.array_repeat(F.col(c), F.greatest(F.lit(0), n).cast("int"))
    frame = F.array_sort(F.concat(outside("first", r - F.col("k") + 1), F.col("near"), outside("last", F.col("k") + r - F.col("n"))))
    return rows.withColumn("smooth", F.element_at(frame, r + 1)).select(*df.columns, "smooth")


def reflected_mean(df: DataFrame, size: int) -> DataFrame:
    """Mean of `size` values from size // 2 before each step on, with the series mirrored at its ends (the end values not repeated).

    Steps count from 1. A series shorter than size // 2 + 1 has no mirror; its rows get null.
    """
    r = size // 2
    sized = df.withColumn("n", F.max("step").over(Window.partitionBy("series")))
    mirrored = F.array(F.col("step"), F.when((F.col("step") > 1) & (F.col("step") <= r + 1), 2 - F.col("step")), F.when((F.col("step") < F.col("n")) & (F.col("step") >= F.col("n") - r), 2 * F.col("n") - F.col("step")))
    padded = sized.where(F.col("n") > r).withColumn("at", F.explode(F.array_compact(mirrored)))
    frame = Window.partitionBy("series").orderBy("at").rowsBetween(-r, size - 1 - r)
    found = padded.withColumn("rolling", F.avg("value").over(frame)).where(F.col("at") == F.col("step")).select("series", "step", "rolling")
    return df.join(found, ["series", "step"], "left")


def ewma(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    """s(1) = x(1); s(t) = alpha x(t) + (1 - alpha) s(t - 1): a fold over each series' own array."""
    listed = df.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("p"))
    start = F.array().cast("array<struct<step:bigint,value:double,smooth:double>>")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(
        x["step"].alias("step"), x["value"].alias("value"),
        F.when(F.size(acc) == 0, x["value"]).otherwise(alpha * x["value"] + (1 - alpha) * F.try_element_at(acc, F.lit(-1))["smooth"]).alias("smooth"),
    )))
    return listed.select("series", F.explode(F.aggregate("p", start, step)).alias("s")).select("series", "s.step", "s.value", "s.smooth")


def running(df: DataFrame) -> DataFrame:
    up = _w().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"cum_sum": F.sum("value").over(up), "cum_max": F.max("value").over(up), "cum_min": F.min("value").over(up), "cum_mean": F.avg("value").over(up)})


def deltas(df: DataFrame) -> DataFrame:
    return df.withColumn("delta", F.col("value") - F.lag("value").over(_w()))


def plateau(df: DataFrame, size: int, tolerance: float) -> DataFrame:
    """(series, start): the first window of `size` steps whose values span at most `tolerance`."""
    frame = _w().rowsBetween(1 - size, 0)
    flat = df.withColumns({"n": F.count("*").over(frame), "span": F.max("value").over(frame) - F.min("value").over(frame), "start": F.first("step").over(frame)})
    return flat.where((F.col("n") == size) & (F.col("span") <= tolerance)).groupBy("series").agg(F.min("start").alias("start"))


def peaks(df: DataFrame, least: float | None = None, distance: int = 1) -> DataFrame:
    """Values strictly above both neighbours and at least `least`; from left to right, each at least `distance` steps behind the last one taken."""
    around = df.withColumns({"l": F.lag("value").over(_w()), "r": F.lead("value").over(_w())})
    found = around.where((F.col("value") > F.col("l")) & (F.col("value") > F.col("r"))).select("series", "step", "value")
    found = found if least is None else found.where(F.col("value") >= least)
    if distance <= 1:
        return found
    listed = found.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("p"))
    start = F.array().cast("array<struct<step:bigint,value:double>>")
    take = lambda acc, x: F.when((F.size(acc) == 0) | (x["step"] - F.try_element_at(acc, F.lit(-1))["step"] >= distance), F.concat(acc, F.array(x))).otherwise(acc)
    return listed.select("series", F.explode(F.aggregate("p", start, take)).alias("s")).select("series", "s.step", "s.value")


def segments(df: DataFrame, holds: Column, half_open: bool = False) -> DataFrame:
    """(series, begin, end, n): maximal runs of steps for which `holds`; the end is the last step, or the one behind it if half open."""
    rows = df.withColumn("k", F.row_number().over(_w())).where(holds)
    rows = rows.withColumn("island", F.col("k") - F.row_number().over(_w()))
    runs = rows.groupBy("series", "island").agg(F.min("step").alias("begin"), F.max("step").alias("end"), F.count("*").alias("n")).drop("island")
    return runs.withColumn("end", F.col("end") + 1) if half_open else runs


def hysteresis(df: DataFrame, low: float, high: float) -> DataFrame:
    """Runs of at least `low` that reach `high`."""
    rows = df.withColumn("k", F.row_number().over(_w())).where(F.col("value") >= low)
    rows = rows.withColumn("island", F.col("k") - F.row_number().over(_w()))
    runs = rows.groupBy("series", "island").agg(F.min("step").alias("begin"), F.max("step").alias("end"), F.max("value").alias("peak"))
    return runs.where(F.col("peak") >= high).drop("island")


def average_rank(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("series").orderBy("value")
    ties = F.count("*").over(Window.partitionBy("series", "value"))
    return df.withColumn("rank", F.rank().over(order) + (ties - 1) / 2.0)


def split(df: DataFrame, size: int, step: int) -> DataFrame:
    """(series, window, step, value): the rows of complete windows only, once for each window that holds them; steps count from 1."""
    sized = df.join(df.groupBy("series").agg(F.max("step").alias("n_")), "series")
    last = F.floor((F.col("n_") - size) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col("step") - size) / step))
    hi = F.least(last, F.floor((F.col("step") - 1) / step))
    rows = sized.where((F.col("n_") >= size) & (lo <= hi)).withColumn("window", F.explode(F.sequence(lo, hi)))
    return rows.select("series", "window", "step", "value")


def windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """(series, window, mean) of complete windows only."""
    return split(df, size, step).groupBy("series", "window").agg(F.avg("value").alias("mean"))


def overlap_add(parts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(series, step, merged): windows(series, window, step, value) put back on lengths(series, n): the mean where they overlap, 0 where none lies."""
    merged = parts.groupBy("series", "step").agg(F.avg("value").alias("merged"))
    steps = lengths.select("series", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("step"))
    return steps.join(merged, ["series", "step"], "left").select("series", "step", F.coalesce("merged", F.lit(0.0)).alias("merged"))


def describe(df: DataFrame, by: list[str]) -> DataFrame:
    totals = df.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return totals.join(percentiles(df, by, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by).select(*by, "n", "mean", "std", "lo", "q25", "q50", "q75", "hi")


def iqr_outliers(df: DataFrame, by: list[str], factor: float = 1.5) -> DataFrame:
    q = percentiles(df, by, "value", {"q1": 0.25, "q3": 0.75})
    reach = factor * (F.col("q3") - F.col("q1"))
    return df.join(q, by).where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).drop("q1", "q3")


def z_outliers(df: DataFrame, by: list[str], limit: float = 2.5) -> DataFrame:
    t = df.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return df.join(t, by).where((F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) / F.col("s") > limit)).drop("m", "s")


def winsorise(df: DataFrame, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    t = percentiles(df, by, "value", {"lo_": low, "hi_": high})
    return df.join(t, by).withColumn("value", F.least("hi_", F.greatest("lo_", "value"))).drop("lo_", "hi_")


def percentile_rank(df: DataFrame, by: list[str], name: str = "percent") -> DataFrame:
    """100 times the share of values strictly below."""
    below = Window.partitionBy(*by).orderBy("value")
    return df.withColumn(name, 100.0 * (F.rank().over(below) - 1) / F.count("*").over(Window.partitionBy(*by)))


def weighted_moments(df: DataFrame, by: list[str], weight: str) -> DataFrame:
    """(by..., mean, std): weighted mean and population deviation; 0 where the weights sum to 0."""
    w, v = F.col(weight), F.col("value")
    sums = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * v).alias("s"), F.sum(w * v * v).alias("q"))
    mean = F.coalesce(F.try_divide(F.col("s"), F.col("w")), F.lit(0.0))
    spread = F.coalesce(F.try_divide(F.col("q"), F.col("w")), F.lit(0.0)) - mean * mean
    return sums.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), spread)).alias("std"))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n): the commonest value of each group, the smallest of equally common ones."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), value)).alias("m"))
    return best.select(*by, f"m.{value}", (-F.col("m.k")).alias("n"))


def histogram(df: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - lo) / ((hi - lo) / bins))).cast("long")
    return df.where((F.col("value") >= lo) & (F.col("value") <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_counting(curve: DataFrame) -> DataFrame:
    """(series, fd) of points (series, x, y): slope of log occupied cells over log resolution for 2**1..2**8 cells, in [1, 2]."""
    ext = curve.groupBy("series").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"), F.count("*").alias("n"))
    rows = curve.join(ext, "series").where("n >= 4 and span > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    cells = F.pow(F.lit(2.0), F.col("k"))
    cell = lambda c, o: F.least(cells - 1, F.floor((F.col(c) - F.col(o)) / F.col("span") * cells)).cast("long")
    counts = rows.select("series", "k", cell("x", "x0").alias("i"), cell("y", "y0").alias("j")).distinct().groupBy("series", "k").agg(F.count("*").alias("c"))
    fit = counts.groupBy("series").agg(F.regr_slope(F.log("c"), F.col("k") * F.log(F.lit(2.0))).alias("s"))
    return ext.select("series").join(fit, "series", "left").select("series", F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.coalesce("s", F.lit(1.0)))).alias("fd"))
