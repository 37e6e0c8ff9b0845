"""Ranks and exact percentiles of large groups: rows are dealt into buckets of value ranges, so that no group is ordered in one task.

Bucket borders are approximate percentiles and decide only how the work is dealt out; the results are exact. Equal
values share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """By keys, or with the other side's only row."""
    return df.join(other, by) if by else df.crossJoin(F.broadcast(other))


def _bucketed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with `bucket_`: the number of borders below the value; null values are the lowest, NaN the highest ones."""
    shares = F.lit([k / BUCKETS for k in range(1, BUCKETS)])
    borders = df.groupBy(*by).agg(F.percentile_approx(value, shares, 1000).alias("borders_"))
    rows = _joined(df, borders, by)
    return rows.withColumn("bucket_", F.coalesce(F.size(F.filter("borders_", lambda b: b < F.col(value))), F.lit(-1))).drop("borders_")


def row_numbers(df: DataFrame, by: list[str], value: str, ties: list[str], name: str = "rank", start: int = 1, descending: bool = True) -> DataFrame:
    """df with consecutive numbers inside each group, in the order of value, then of the ties' columns."""
    rows = _bucketed(df, by, value)
    sizes = rows.groupBy(*by, "bucket_").agg(F.count("*").alias("n_"))
    earlier = Window.partitionBy(*by).orderBy(F.desc("bucket_") if descending else F.asc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "bucket_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))  # BUCKETS rows a group
    order = Window.partitionBy(*by, "bucket_").orderBy(F.desc_nulls_last(value) if descending else F.asc_nulls_first(value), *ties)
    numbered = rows.join(before, [*by, "bucket_"]).withColumn(name, (F.row_number().over(order) + F.col("before_") + (start - 1)).cast("long"))
    return numbered.select(*df.columns, name)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., a column per share): linearly interpolated percentiles of the values that aren't null."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    rows = _bucketed(counted, by, "v_")
    sizes = rows.groupBy(*by, "bucket_").agg(F.sum("c_").alias("n_"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "bucket_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"), F.sum("n_").over(group).alias("all_"))
    order = Window.partitionBy(*by, "bucket_").orderBy("v_")
    rows = rows.join(sizes, [*by, "bucket_"]).withColumn("upto_", F.col("before_") + F.sum("c_").over(order))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("upto_") > index) & (F.col("upto_") - F.col("c_") <= index), F.col("v_")))

    aggs = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("all_") - 1)
        aggs += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_at")]
    found = rows.groupBy(*by).agg(*aggs)
    return found.select(*by, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_at")).alias(n) for n in shares])
