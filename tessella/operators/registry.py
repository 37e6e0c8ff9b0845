"""Named matchers, filters and validators, and functions over items with retries.

A matcher is a Column expression of two edges' columns; a filter takes and gives a DataFrame of pairs; a validator takes a DataFrame of
placed fragments and gives one row (score). All stay plans; only `applied` calls Python per item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import curves

MATCHERS: dict[str, Callable[[], Column]] = {}
FILTERS: dict[str, Callable[..., DataFrame]] = {}
VALIDATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(kind: dict[str, Callable], name: str):
    def add(f: Callable) -> Callable:
        kind[name] = f
        return f

    return add


def matched(pairs: DataFrame, names: Iterable[str]) -> DataFrame:
    """pairs with a column per matcher: its score in [0, 1]; where it has none (null, not a number) 0."""
    safe = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(c.cast("double"), F.lit(0.0)))), F.lit(0.0))
    return pairs.withColumns({n: safe(MATCHERS[n]()) for n in names})


def filtered(pairs: DataFrame, steps: Iterable[tuple[str, dict]]) -> DataFrame:
    """The filters one after another."""
    return reduce(lambda df, step: FILTERS[step[0]](df, **step[1]), steps, pairs)


def validated(placed: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """(validator, score) by each of the named validators, all of them without names."""
    rows = [VALIDATORS[n](placed).select(F.lit(n).alias("validator"), F.col("score").cast("double").alias("score")) for n in sorted(names or VALIDATORS)]
    return reduce(DataFrame.unionByName, rows)


def applied(items: DataFrame, column: str, fn: Callable[[object], object], result: str = "string", retries: int = 0) -> DataFrame:
    """items with (success, result, error, retries): fn per item, tried up to `retries` times again; errors are told, not raised."""
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = []
            for item in pdf[column]:
                done, value, error, used = False, None, None, 0
                for again in range(retries + 1):
                    try:
                        done, value, error, used = True, fn(item), None, again
                        break
                    except Exception as e:  # noqa: BLE001 - whatever the function raises is told in the row
                        error, used = f"{type(e).__name__}: {e}", min(again + 1, retries)
                told.append((done, value, error, used))
            yield pdf.assign(**{n: [t[k] for t in told] for k, n in enumerate(("success", "result", "error", "retries"))})

    return items.mapInPandas(run, f"{schema}, success boolean, result {result}, error string, retries long")


@register(MATCHERS, "css")
def _css() -> Column:
    return V.css_similarity_mirror(F.col("css_x"), F.col("css_y"))


@register(MATCHERS, "dtw")
def _dtw() -> Column:
    return V.similarity_of(curves.dtw("curve_x", "curve_y", mirror=True))


@register(MATCHERS, "fd")
def _fd() -> Column:
    return V.similarity_of(F.abs(F.col("fd_x") - F.col("fd_y")))


@register(MATCHERS, "length")
def _length() -> Column:
    return F.least("length_x", "length_y") / F.greatest("length_x", "length_y")


@register(MATCHERS, "cosine")
def _cosine() -> Column:
    return V.cosine(F.col("ifs_x"), F.col("ifs_y"))


@register(FILTERS, "score")
def _by_score(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    return pairs.where(F.col("score") >= least)


@register(FILTERS, "range")
def _by_range(pairs: DataFrame, column: str = "score", low: float = 0.0, high: float = 1.0) -> DataFrame:
    return pairs.where(F.col(column).between(low, high))


@register(FILTERS, "best")
def _best(pairs: DataFrame) -> DataFrame:
    from .ranking import dedup_keep_best

    return dedup_keep_best(pairs)


@register(FILTERS, "top")
def _top(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "a", "b").limit(k)


@register(VALIDATORS, "finite")
def _finite(placed: DataFrame) -> DataFrame:
    """Share of fragments whose place is a number."""
    sound = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    return placed.agg(F.coalesce(F.avg(F.coalesce(sound, F.lit(False)).cast("int")), F.lit(1.0)).alias("score"))


@register(VALIDATORS, "unique")
def _unique(placed: DataFrame) -> DataFrame:
    """Share of rows that name a fragment for the first time."""
    return placed.agg(F.coalesce(F.try_divide(F.count_distinct("id"), F.count("*")), F.lit(1.0)).alias("score"))


@register(VALIDATORS, "placement")
def _apart(placed: DataFrame) -> DataFrame:
    """1 - share of fragments at the place of an earlier one."""
    spots = placed.groupBy("x", "y").agg(F.count("*").alias("n"))
    return spots.agg(F.coalesce(F.try_divide(F.count("*"), F.sum("n")), F.lit(1.0)).alias("score"))


@register(VALIDATORS, "overlap")
def _overlap(placed: DataFrame) -> DataFrame:
    """1 - overlapping area by the sum of areas."""
    from .layout import overlaps

    area = placed.agg(F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0.0)).alias("area"))
    shared = overlaps(placed.select("id", "x", "y", "w", "h"), 64.0).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("shared"))
    return area.crossJoin(F.broadcast(shared)).select((1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("shared"), F.col("area")), F.lit(0.0)))).alias("score"))
