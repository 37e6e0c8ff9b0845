"""The engine's registered queries over the provided tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import curves, evaluation, events, kernels, layout, ranking, series, similar, text, thresholds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(x: Column | str, digits: int) -> Column:
    """As the SQL engine rounds: the product is rounded, half away from zero; Spark's own rounding goes by the decimal digits and parts from it at halves."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * float(10**digits)) / float(10**digits)


def _rounded_quickly(x: Column | str, digits: int) -> Column:
    """As `_rounded` for numbers from 0 on, without the decimals that Spark's rounding makes of each, which take longer than the rest where rows are billions."""
    y = (F.col(x) if isinstance(x, str) else x) * float(10**digits)
    return F.when(F.abs(y - F.rint(y)) == 0.5, y + 0.5).otherwise(F.rint(y)) / float(10**digits)


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _rounded(c, 6) for c in columns})


# --- ranked lists: suppliers by quantity per return flag -----------------------------------------------------------
_LISTS = """l0 as (select l_returnflag as list_id, l_suppkey as item, sum(l_quantity) as score from lineitem group by 1, 2),
lists as (select *, row_number() over (partition by list_id order by score desc, item) as rank from l0)"""
_WEIGHT = "case list_id when 'A' then 2.0 when 'N' then 1.0 else 0.5 end"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    sums = _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("list_id"), F.col("l_suppkey").alias("item")).agg(F.sum("l_quantity").alias("score"))
    return ranking.ranked_lists(sums)


@query(f"with {_LISTS} select item, round(sum(1.0 / (60 + rank)), 6) as fused from lists group by item")
def rank_reciprocal_fusion(spark, d):
    return _r(ranking.reciprocal_rank_fusion(_lists(spark, d)), "fused")


@query(f"with {_LISTS}, s as (select item, sum({_WEIGHT} / (60 + rank)) as s from lists group by item) select item, round(s / (select max(s) from s), 6) as fused from s")
def rank_weighted_fusion(spark, d):
    return _r(ranking.weighted_rrf(_lists(spark, d), F.expr(_WEIGHT)), "fused")


@query(f"with {_LISTS}, n as (select list_id, count(*) as n from lists group by 1) select item, sum(n - rank)::bigint as points from lists join n using (list_id) group by item")
def rank_borda(spark, d):
    return ranking.borda_count(_lists(spark, d))


@query(f"""with {_LISTS}, m as (select list_id, min(score) lo, max(score) hi from lists group by 1)
select item, round(sum({_WEIGHT} * case when hi - lo < 1e-12 then 1.0 else (score - lo) / (hi - lo) end) / 3.5, 6) as fused from lists join m using (list_id) group by item""")
def rank_score_fusion(spark, d):
    return _r(ranking.score_fusion(_lists(spark, d), F.expr(_WEIGHT)), "fused")


# --- pair scores: parts and suppliers folded to 40 fragments, a channel per return flag ------------------------------
_PAIRS = """ch as (select l_suppkey % 40 as a, l_partkey % 40 as b, l_returnflag as channel, avg(l_discount) * 10 as score from lineitem where l_suppkey % 40 <> l_partkey % 40 group by 1, 2, 3),
pairs as (select a, b, avg(score) as score from ch group by 1, 2),
best as (select least(a, b) as a, greatest(a, b) as b, max(score) as score from pairs group by 1, 2)"""


#: Identifiers of both ends of a pair.
FOLDED = ("l_suppkey % 40", "l_partkey % 40")
#: The real ones: even for suppliers and odd for parts, so that no two coincide.
WHOLE = ("l_suppkey * 2", "l_partkey * 2 + 1")


def _channels(spark: SparkSession, d: str, ids: tuple[str, str] = FOLDED) -> DataFrame:
    a, b = map(F.expr, ids)
    rows = _t(spark, d, "lineitem").where(a != b).groupBy(a.alias("a"), b.alias("b"), F.col("l_returnflag").alias("channel")).agg((F.avg("l_discount") * 10).alias("score"))
    # The real pairs' scores are rounded, so that thresholds and ties don't hang on the order of a sum.
    return rows if ids == FOLDED else rows.withColumn("score", F.round("score", 9))


def _pairs(spark: SparkSession, d: str, ids: tuple[str, str] = FOLDED) -> DataFrame:
    # Rounded, so that ties don't hang on the order of a sum.
    return _channels(spark, d, ids).groupBy("a", "b").agg(F.avg("score").alias("score")).withColumn("score", F.round("score", 6))


_PAIRS = _PAIRS.replace("avg(score) as score from ch", "round(avg(score), 6) as score from ch")


@query(f"with {_PAIRS} select * from best")
def pair_dedup_best(spark, d, ids=FOLDED):
    return ranking.dedup_keep_best(_pairs(spark, d, ids))


@query(f"with {_PAIRS}, e as (select a as id, b as other, score from best union all select b, a, score from best), r as (select *, row_number() over (partition by id order by score desc, other) as rank from e) select * from r where rank <= 5")
def pair_top_k_both_ends(spark, d, ids=FOLDED):
    return ranking.top_k_both_ends(ranking.dedup_keep_best(_pairs(spark, d, ids)), 5)


@query(f"with {_PAIRS} select a, b, score, row_number() over (order by score desc, a, b) as rank from best where score >= 0.5 order by score desc, a, b limit 100")
def pair_rank_from_one(spark, d, ids=FOLDED):
    return ranking.rank_pairs(_pairs(spark, d, ids), 0.5, 100)


@query(f"with {_PAIRS}, e as (select a as id, score from best union all select b, score from best) select id, round(avg(score) + 1e-9, 6) as mean_score from e group by id")
def pair_endpoint_means(spark, d, ids=FOLDED):
    # Means of rounded scores may end in a 5, where the order of the sum would decide.
    means = ranking.endpoint_means(ranking.dedup_keep_best(_pairs(spark, d, ids)))
    return _r(means.withColumn("mean_score", F.col("mean_score") + 1e-9), "mean_score")


@query(f"""with {_PAIRS}, m as (select channel, min(score) lo, max(score) hi from ch group by 1)
select least(a, b) as a, greatest(a, b) as b, round(sum(case channel when 'A' then 0.6 when 'R' then 0.4 else 0 end * (score - lo) / (hi - lo)) / 2 / (select sum(case channel when 'A' then 0.6 when 'R' then 0.4 else 0 end) from m), 6) as score from ch join m using (channel) group by 1, 2""")
def pair_channel_matrix(spark, d, ids=FOLDED):
    """A weight for a channel that is not there counts in no divisor; the channel without a weight counts 0."""
    return _r(ranking.aggregate_channels(_channels(spark, d, ids), {"A": 0.6, "R": 0.4, "absent": 2.0}), "score")


@query(f"with {_PAIRS}, v as (select least(a, b) as a, greatest(a, b) as b, count(*) as votes from ch where score >= 0.5 group by 1, 2 having count(*) >= 2) select a, b, votes, round(votes / (select max(votes) from v), 6) as share from v")
def pair_votes(spark, d, ids=FOLDED):
    return _r(ranking.pair_votes(_channels(spark, d, ids).where("score >= 0.5"), 2), "share")


@query()
def pair_greedy_matching(spark, d, ids=FOLDED):
    return ranking.greedy_matching(_channels(spark, d, ids), ["channel"])


# --- normalisation and thresholds over order prices ------------------------------------------------------------------
_O = "orders"


@query("select o_orderkey, round((o_totalprice - (select min(o_totalprice) from orders)) / (select max(o_totalprice) - min(o_totalprice) from orders), 6) as normed from orders")
def norm_minmax(spark, d):
    return _r(thresholds.minmax(_t(spark, d, _O), "o_totalprice").select("o_orderkey", "normed"), "normed")


@query("with t as (select avg(o_totalprice) m, stddev_pop(o_totalprice) s from orders) select o_orderkey, round((greatest(-3, least(3, (o_totalprice - m) / s)) + 3) / 6, 6) as normed from orders, t")
def norm_zscore(spark, d):
    return _r(thresholds.zscore(_t(spark, d, _O), "o_totalprice").select("o_orderkey", "normed"), "normed")


@query(f"with {_PAIRS}, m as (select a, max(score) t from pairs group by a), e as (select pairs.a, b, exp(score - t) as x from pairs join m on pairs.a = m.a) select a, b, round(x / sum(x) over (partition by a), 6) as normed from e")
def norm_softmax_rows(spark, d, ids=FOLDED):
    return _r(thresholds.softmax(_pairs(spark, d, ids), "score", ["a"]).select("a", "b", "normed"), "normed")


@query(f"with {_PAIRS} select a, b, round(case when abs(max(score) over (partition by a)) < 1e-12 then 0 else score / max(score) over (partition by a) end, 6) as normed from pairs")
def norm_row_max(spark, d, ids=FOLDED):
    return _r(thresholds.row_normalise(_pairs(spark, d, ids), "score", ["a"], "max").select("a", "b", "normed"), "normed")


@query("select round(quantile_cont(o_totalprice, 0.95), 6) as threshold from orders")
def threshold_percentile(spark, d):
    return _r(thresholds.percentile_threshold(_t(spark, d, _O), "o_totalprice", 95), "threshold")


@query("""with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders),
h as (select least(255, floor((o_totalprice - lo) / (hi - lo) * 256))::int as bin, count(*) as n from orders, s group by 1),
g as (select i::int as bin, lo, hi, coalesce(n, 0)::double as n from range(256) r(i) cross join s left join h on h.bin = i),
c as (select *, sum(n) over (order by bin) w1, sum(n * (lo + (bin + 0.5) * (hi - lo) / 256)) over (order by bin) s1, sum(n) over () w, sum(n * (lo + (bin + 0.5) * (hi - lo) / 256)) over () s from g),
v as (select *, case when w1 > 0 and w > w1 then w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) ^ 2 else 0 end as v from c),
b as (select lo, hi, list(bin order by bin) as l from v where v >= (select max(v) from v) * (1 - 1e-10) group by lo, hi)
select round(lo + (l[len(l) // 2 + 1] + 1) * (hi - lo) / 256, 6) as threshold from b""")
def threshold_otsu(spark, d):
    return _r(thresholds.otsu(_t(spark, d, _O), "o_totalprice"), "threshold")


@query("""with x as (select n_chars::double as s, quality as y from documents join labels using (doc_id)), p as (select min(s) lo, max(s) hi from x),
g as (select i, lo + (hi - lo) * i / 49 as t from range(50) r(i), p), f as (select i, t, 2.0 * sum(case when s >= t then y else 0 end) / (sum(y) + count(*) filter (s >= t)) as f from g, x group by i, t)
select round(t, 6) as threshold, round(f, 6) as fbeta from f order by f desc, i limit 1""")
def threshold_fbeta(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s")).join(_t(spark, d, "labels"), "doc_id")
    return _r(thresholds.fbeta_sweep(rows, "s", "quality"), "threshold", "fbeta")


# --- series: events per user -----------------------------------------------------------------------------------------
_SERIES = "s as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) as step, value from events)"
_OW = "over (partition by series order by step"


def _series(spark: SparkSession, d: str, value: Column | str = "value") -> DataFrame:
    e = _t(spark, d, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("series"), step.alias("step"), F.col(value).alias("value") if isinstance(value, str) else value.alias("value"))


@query(f"with {_SERIES} select *, round(avg(value) {_OW} rows between 7 preceding and current row), 6) as trailing from s")
def series_trailing_mean(spark, d):
    return _r(series.trailing_mean(_series(spark, d), 8), "trailing")


@query(f"with {_SERIES} select *, round(avg(value) {_OW} rows between 2 preceding and 2 following), 6) as sliding from s")
def series_sliding_mean(spark, d):
    return _r(series.sliding_mean(_series(spark, d), 5), "sliding")


@query(f"""with {_SERIES}, n as (select series, count(*) n, arg_min(value, step) f, arg_max(value, step) l from s group by 1)
select series, step, value, round((sum(value) {_OW} rows between 2 preceding and 2 following) + greatest(0, 3 - step) * f + greatest(0, step + 2 - n) * l) / 5, 6) as smooth from s join n using (series)""")
def series_edge_padded_mean(spark, d):
    return _r(series.edge_padded_mean(_series(spark, d), 5), "smooth")


@query(f"with {_SERIES} select *, round(sum(value) {_OW}), 6) as cum_sum, max(value) {_OW}) as cum_max, min(value) {_OW}) as cum_min, round(avg(value) {_OW}), 9) as cum_mean from s")
def series_running(spark, d):
    return _r(series.running(_series(spark, d)), "cum_sum").withColumn("cum_mean", F.round("cum_mean", 9))


@query(f"with {_SERIES} select *, round(value - lag(value) {_OW}), 6) as delta from s")
def series_deltas(spark, d):
    return _r(series.deltas(_series(spark, d)), "delta")


@query(f"with {_SERIES}, f as (select *, count(*) {_OW} rows 2 preceding) n, max(value) {_OW} rows 2 preceding) - min(value) {_OW} rows 2 preceding) as span, first(step) {_OW} rows 2 preceding) as start from s) select series, min(start) as start from f where n = 3 and span <= 20 group by 1")
def series_plateau(spark, d):
    return series.plateau(_series(spark, d), 3, 20.0)


@query(f"with {_SERIES}, f as (select *, lag(value) {_OW}) l, lead(value) {_OW}) r from s) select series, step, value from f where value > l and value > r")
def series_peaks(spark, d):
    return series.peaks(_series(spark, d))


_ISLANDS = f"{_SERIES}, i as (select *, step - row_number() {_OW}) as k from s where value >= 40)"


@query(f"with {_ISLANDS} select series, min(step) as begin, max(step) as \"end\", count(*) as n from i group by series, k")
def series_segments(spark, d):
    return series.segments(_series(spark, d), F.col("value") >= 40)


@query(f"with {_ISLANDS} select series, min(step) as begin, max(step) as \"end\", max(value) as peak from i group by series, k having max(value) >= 90")
def series_hysteresis(spark, d):
    return series.hysteresis(_series(spark, d), 40.0, 90.0)


@query(f"with {_SERIES} select *, rank() over (partition by series order by value) + (count(*) over (partition by series, value) - 1) / 2.0 as rank from s")
def series_average_rank(spark, d):
    return series.average_rank(_series(spark, d))


@query(f"""with {_SERIES}, n as (select series, max(step) n from s group by 1), w as (select series, unnest(range(0, ((n - 8) // 4 + 1)::bigint)) as "window" from n where n >= 8)
select w.series, "window", round(avg(value), 6) as mean from w join s on s.series = w.series and step > "window" * 4 and step <= "window" * 4 + 8 group by 1, 2""")
def series_windows(spark, d):
    return _r(series.windows(_series(spark, d), 8, 4), "mean")


@query("""select l_returnflag, count(*) as n, round(avg(l_extendedprice), 6) as mean, round(stddev_pop(l_extendedprice), 6) as std, min(l_extendedprice) as lo, round(quantile_cont(l_extendedprice, 0.25), 6) as q25,
round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.75), 6) as q75, max(l_extendedprice) as hi from lineitem group by 1""")
def stats_describe(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    return _r(series.describe(rows, ["l_returnflag"]), "mean", "std", "q25", "q50", "q75")


@query("with q as (select event_type, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events group by 1) select event_id, event_type, value from events join q using (event_type) where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)")
def stats_iqr_outliers(spark, d):
    return series.iqr_outliers(_t(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"])


@query("with q as (select event_type, avg(value) m, stddev_pop(value) s from events group by 1) select event_id, event_type, value from events join q using (event_type) where abs(value - m) / s > 2.5")
def stats_z_outliers(spark, d):
    return series.z_outliers(_t(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"])


@query("with q as (select event_type, quantile_cont(value, 0.05) a, quantile_cont(value, 0.95) b from events group by 1) select event_id, event_type, round(least(b, greatest(a, value)), 6) as value from events join q using (event_type)")
def stats_winsorise(spark, d):
    return _r(series.winsorise(_t(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"]), "value")


@query("select least(19, floor(l_quantity / 2.5))::bigint as bin, count(*) as n from lineitem where l_quantity between 0 and 50 group by 1")
def stats_histogram(spark, d):
    return series.histogram(_t(spark, d, "lineitem").select(F.col("l_quantity").alias("value")), 20, 0.0, 50.0)


@query(f"""with {_SERIES}, x as (select series, min(step) x0, min(value) y0, greatest(max(step) - min(step), max(value) - min(value)) as span, count(*) n from s group by 1),
c as (select distinct series, k, least(2 ^ k - 1, floor((step - x0) / span * 2 ^ k)) i, least(2 ^ k - 1, floor((value - y0) / span * 2 ^ k)) j from s join x using (series), range(1, 9) r(k) where n >= 4 and span > 0),
n as (select series, k, count(*) c from c group by 1, 2), f as (select series, regr_slope(ln(c), k * ln(2)) m from n group by 1)
select series, round(greatest(1.0, least(2.0, coalesce(m, 1.0))), 6) as fd from x left join f using (series)""")
def fractal_box_counting(spark, d):
    curve = _series(spark, d).select("series", F.col("step").cast("double").alias("x"), F.col("value").alias("y"))
    return _r(series.box_counting(curve), "fd")


# --- vectors ---------------------------------------------------------------------------------------------------------
_QV = "q as (select vec_id as a, embedding::double[] as x from embeddings where vec_id % 20 = 0), v as (select vec_id as b, embedding::double[] as y from embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _scored_pairs(spark: SparkSession, d: str, keep: int = 0) -> DataFrame:
    """(a, b, c, d): cosine and distance of query vectors (vec_id divisible by 20, the stated set of the search) and all rows.

    Rounded, so that ties don't hang on the order of a sum.
    """
    e = _vectors(spark, d)
    return similar.scored(e.where("id % 20 = 0"), e, keep).withColumns({"c": F.round("c", 9), "d": F.round("d", 9)})


@query(f"with {_QV}, r as (select a, b, round(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 9) as c from q join v on a <> b), k as (select a, b, round(c, 6) as cosine, row_number() over (partition by a order by c desc, b) as rank from r) select * from k where rank <= 5")
def vector_nearest(spark, d):
    rows = _scored_pairs(spark, d, 5).select("a", "b", F.col("c").alias("cosine"))
    return _r(ranking.with_rank(rows, ["a"], "cosine", ["b"]).where("rank <= 5"), "cosine")


@query(f"""with {_QV}, r as (select a, b, round(list_distance(x, y), 9) as d from q join v on a <> b), k as (select *, row_number() over (partition by a order by d, b) as n from r)
select a, arg_min(b, n) as b, round(min(d), 6) as d1, round(max(d), 6) as d2 from k where n <= 2 group by a having max(d) > 1e-12 and min(d) / max(d) < 0.9""")
def vector_ratio_test(spark, d):
    return _r(similar.ratio_test(_scored_pairs(spark, d, 2), 0.9), "d1", "d2")


# --- layout: parts as placed rectangles ------------------------------------------------------------------------------
_BOX = "box as (select p_partkey as id, (p_partkey * 37 % 1201)::double as x, (p_partkey * 61 % 1203)::double as y, p_size::double as w, (p_size / 2 + 1)::double as h from part)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(k.alias("id"), (k * 37 % 1201).cast("double").alias("x"), (k * 61 % 1203).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), (F.col("p_size") / 2 + 1).cast("double").alias("h"))


_OVER = f"{_BOX}, o as (select a.id as a, b.id as b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as area, a.w * a.h as sa, b.w * b.h as sb from box a join box b on a.id < b.id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)"


@query(f"with {_OVER} select a, b, round(area, 6) as area, round(area / (sa + sb - area), 6) as iou from o")
def layout_overlaps(spark, d):
    boxes = _boxes(spark, d)
    return _r(layout.rated_overlaps(boxes, 64.0), "area", "iou")


@query(f"with {_BOX} select a.id as a, b.id as b, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 6) as d from box a join box b on a.id <> b.id and (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 <= 2500 ")
def layout_radius_join(spark, d):
    boxes = _boxes(spark, d)
    return _r(ranking.distance_join(boxes, boxes, 50.0), "d")


@query(f"with {_BOX} select id, x, y, w, h from box where x + w > 1200 or y + h > 1200")
def layout_out_of_bounds(spark, d):
    return layout.out_of_bounds(_boxes(spark, d), 1200.0, 1200.0)


@query(f"""with {_BOX}, p as (select a.id as a, b.id as b, greatest(b.x - (a.x + a.w), a.x - (b.x + b.w)) as gap_x, greatest(b.y - (a.y + a.h), a.y - (b.y + b.h)) as gap_y from box a join box b on a.id < b.id and sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 60)
select *, case when greatest(gap_x, gap_y) < 0 then 'overlap' when greatest(gap_x, gap_y) = 0 then 'touching' when greatest(gap_x, gap_y) <= 5 then 'near' else 'far' end as kind from p""")
def layout_gaps(spark, d):
    """Every two boxes whose corners lie within 60 of each other."""
    boxes = _boxes(spark, d)
    near = ranking.near_pairs(boxes, 60.0, carry="xywh")
    pairs = near.withColumnsRenamed({c + n: c + end for c in "xywh" for n, end in ("1a", "2b")})  # gaps are the same both ways
    return layout.gaps(pairs).select("a", "b", "gap_x", "gap_y", "kind")


@query("with b as (select l_suppkey % 97 as x, l_partkey % 89 as y, min(l_orderkey * 10 + l_linenumber) as f from lineitem group by 1, 2) select f as first_id, l_orderkey * 10 + l_linenumber as id from lineitem join b on x = l_suppkey % 97 and y = l_partkey % 89 where l_orderkey * 10 + l_linenumber > f")
def layout_duplicate_places(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = _t(spark, d, "lineitem").select(k.alias("id"), (F.col("l_suppkey") % 97).alias("x"), (F.col("l_partkey") % 89).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    return layout.duplicate_places(rows)


# --- evaluation ------------------------------------------------------------------------------------------------------
@query("""with p as (select distinct least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_returnflag = 'A'),
t as (select distinct least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_linestatus = 'F'), h as (select count(*) n from p join t using (a, b)),
m as (select h.n / (select count(*) from p) as precision, h.n / (select count(*) from t) as recall from h) select round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall), 6) as f1 from m""")
def eval_pair_metrics(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag", "l_linestatus")
    return _r(evaluation.pair_metrics(rows.where("l_returnflag = 'A'"), rows.where("l_linestatus = 'F'")), "precision", "recall", "f1")


@query("with n as (select source, lang, count(*) n from documents group by 1, 2), m as (select source, max(n) t, sum(n) n from n group by 1) select round(sum(t) / sum(n), 6) as purity from m")
def eval_purity(spark, d):
    return _r(evaluation.purity(_t(spark, d, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("label"))), "purity")


@query("""with c as (select source, lang, count(*) n from documents group by 1, 2), b as (select sum(n * (n - 1) / 2) x, sum(n) n from c), r as (select sum(n * (n - 1) / 2) x from (select sum(n) n from c group by source)),
k as (select sum(n * (n - 1) / 2) x from (select sum(n) n from c group by lang)) select round((b.n * (b.n - 1) / 2 - r.x - k.x + 2 * b.x) / (b.n * (b.n - 1) / 2), 6) as rand from b, r, k""")
def eval_rand_index(spark, d):
    return _r(evaluation.rand_index(_t(spark, d, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("label"))), "rand")


@query("with a as (select count(*) e, count(l) p from (select distinct doc_id from documents) left join (select distinct doc_id, 1 as l from labels) using (doc_id)) select e as n_expected, p as n_placed, round(p / e, 6) as share from a")
def eval_completeness(spark, d):
    ids = lambda t: _t(spark, d, t).select(F.col("doc_id").alias("id"))
    return _r(evaluation.completeness(ids("documents"), ids("labels")), "share")


# --- text and events -------------------------------------------------------------------------------------------------
@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё]{2,}') as w from documents), p as (select doc_id, unnest(list_zip(w[:-2], w[2:])) as p from w where len(w) > 1),
b as (select doc_id, p[1] as w1, p[2] as w2 from p), c2 as (select w1, w2, count(*) c2 from b group by 1, 2), c1 as (select w1, sum(c2) c1 from c2 group by 1), v as (select count(*) v from (select w1 from c2 union select w2 from c2)),
h as (select doc_id, -avg(ln((c2 + 1) / (c1 + v))) h, max(v) v from b join c2 using (w1, w2) join c1 using (w1), v group by 1) select doc_id, round(coalesce(greatest(0, least(1, 1 - h / ln(v + 1))), 0), 6) as coherence from documents left join h using (doc_id)""")
def text_coherence(spark, d):
    return _r(text.coherence(_t(spark, d, "documents").select("doc_id", "text")), "coherence")


@query()
def text_turn_similarity(spark, d):
    """By all characters of both turns; the SQL engine's distance counts bytes, so a test holds it against a plain version."""
    return _turn_similarity(_t(spark, d, "conversations"))


def _turn_similarity(rows: DataFrame) -> DataFrame:
    turns = rows.withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("prev is not null")
    return _r(turns.select("conv_id", "turn", V.text_similarity(F.col("text"), F.col("prev")).alias("similarity")), "similarity")


_LOG = "log as (select event_id, user_id, event_type as name, case event_type when 'error' then 'error' when 'purchase' then 'warning' when 'signup' then 'info' else 'debug' end as level, ts, value from events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    level = F.expr("case event_type when 'error' then 'error' when 'purchase' then 'warning' when 'signup' then 'info' else 'debug' end")
    return _t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("name"), level.alias("level"), "ts", "value")


@query(f"with {_LOG} select user_id, count(*) as n_events, count(distinct name) as n_names, round(avg(case when level in ('error', 'critical') then 1.0 else 0.0 end), 6) as error_rate, epoch_us(max(ts)) - epoch_us(min(ts)) as duration_us from log group by 1")
def event_summary(spark, d):
    return _r(events.summary(_log(spark, d), ["user_id"]), "error_rate")


@query(f"with {_LOG} select event_id, user_id, name, level, ts, value from log where level in ('warning', 'error', 'critical')")
def event_level_filter(spark, d):
    return events.level_at_least(_log(spark, d), "warning")


@query(f"with {_LOG}, k as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from log) select event_id, user_id, name, level, ts, value from k where k <= 10")
def event_retention(spark, d):
    return events.retained(_log(spark, d), ["user_id"], 10)


# --- kernels ---------------------------------------------------------------------------------------------------------
@query()
def kernel_dtw(spark, d):
    """Each query user's series (ids divisible by 20) against every other user's."""
    s = _series(spark, d).groupBy(F.col("series").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda p: p["value"]).alias("c"))
    return _r(curves.crossed(s.where("name % 20 = 0"), s, lambda xs, ys: {"dtw": curves.dtw_block(xs, ys)}, ("dtw",)), "dtw")


@query()
def kernel_greedy_sequence(spark, d, ids=FOLDED):
    return kernels.greedy_sequence(_channels(spark, d, ids).select("channel", F.col("a").alias("i"), F.col("b").alias("j"), "score"), ["channel"])


# --- flagship: vectors to fused ranking ------------------------------------------------------------------------------
@query(f"""with {_QV}, r as (select a, b, round(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 9) as c, round(list_distance(x, y), 9) as d from q join v on a <> b),
t as (select quantile_cont(c, 0.95) as t from r), k as (select a, b, row_number() over (partition by a order by c desc, b) as rc, row_number() over (partition by a order by d, b) as rd from r, t where c >= t)
select a, b, round(1.0 / (60 + rc) + 1.0 / (60 + rd), 6) as fused from k where rc <= 5""")
def match_stage(spark, d):
    """Score, threshold, rank and fuse: the engine's matching stage from load to ranking. Pairs are counted where they meet, none is written."""
    e = _vectors(spark, d)
    ranked = similar.matched(e.where("id % 20 = 0"), e, 95, 5)
    return ranked.select("a", "b", F.round(1 / (60 + F.col("rc")) + 1 / (60 + F.col("rd")), 6).alias("fused"))
