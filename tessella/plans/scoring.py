"""Registered queries of the scoring operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, scoring, text, thresholds
from .queries import FOLDED, _OW, _PAIRS, _SERIES, _channels, _pairs, _r, _rounded, _series, _t, query

_WEIGHTS = {"A": 0.6, "R": 0.3}
_CH = f"{_PAIRS}, c as (select a, b, channel, round(score, 6) as score from ch)"


def _ch(spark: SparkSession, d: str, ids: tuple[str, str] = FOLDED) -> DataFrame:
    return _channels(spark, d, ids).withColumn("score", F.round("score", 6))


def _w(missing: float) -> str:
    return f"case channel when 'A' then 0.6::double when 'R' then 0.3::double else {missing}::double end"


_CLIP = lambda x: f"greatest(0, least(1, {x}))"


@query(f"""with {_CH} select a, b, round({_CLIP(f'sum({_w(1.0)} * score) / (sum({_w(1.0)}) + 1e-12)')}, 6) as weighted, round({_CLIP('avg(score)')}, 6) as mean, {_CLIP('min(score)')} as low, {_CLIP('max(score)')} as high,
round({_CLIP('median(score)')}, 6) as median, round({_CLIP('product(score)')}, 6) as product, round((count(*) + 1) / (2 * count(*)), 6) as rank, round({_CLIP('count(*) / sum(1 / greatest(score, 1e-9))')}, 6) as harmonic,
round({_CLIP('exp(avg(ln(greatest(score, 1e-9))))')}, 6) as geometric from c group by a, b""")
def score_strategies(spark, d, ids=FOLDED):
    return _r(scoring.strategies(_ch(spark, d, ids), _WEIGHTS), "weighted", "mean", "median", "product", "rank", "harmonic", "geometric")


@query(f"with {_CH} select a, b, round(greatest(0, least(1, sum({_w(1.0)} * score) / sum({_w(1.0)}))), 6) as score from c group by a, b")
def score_weighted_combine(spark, d, ids=FOLDED):
    return _r(scoring.weighted_combine(_ch(spark, d, ids), _WEIGHTS), "score")


@query(f"with {_CH}, s as (select a, b, sum({_w(0.0)} * greatest(0, least(1, score))) / (sum({_w(0.0)}) + 1e-12) as score from c group by a, b) select a, b, round(score, 6) as score, score >= 0.7 as confident from s")
def score_match(spark, d, ids=FOLDED):
    return _r(scoring.match_score(_ch(spark, d, ids), _WEIGHTS), "score")


@query(f"with {_CH} select a, b, round(sum({_w(1.0)} * case when score >= 0.5 then score else 0 end) / sum({_w(1.0)}), 6) as evidence, count(*) filter (score >= 0.5) as n_used from c group by a, b")
def score_evidence(spark, d, ids=FOLDED):
    return _r(scoring.evidence(_ch(spark, d, ids), _WEIGHTS, 0.5), "evidence")


@query(f"with {_CH}, r as (select *, row_number() over (partition by channel order by score desc, a, b) - 1 as r, count(*) over (partition by channel) as n from c) select a, b, round(1 - avg(case when n > 1 then r / (n - 1) else 0 end), 6) as score from r group by a, b")
def score_rank_combine(spark, d, ids=FOLDED):
    return _r(scoring.rank_combine(_ch(spark, d, ids)), "score")


@query(f"with {_PAIRS} select a, b, round(case when count(*) over (partition by a) = 1 then 0 when max(score) over (partition by a) - min(score) over (partition by a) < 1e-12 then 0.5 else (row_number() over (partition by a order by score, b) - 1) / (count(*) over (partition by a) - 1) end, 6) as normed from pairs")
def norm_rank_rows(spark, d, ids=FOLDED):
    return _r(scoring.rank_in_rows(_pairs(spark, d, ids), "score", ["a"], ["b"]).select("a", "b", "normed"), "normed")


@query(f"with {_PAIRS} select a, b, round(1 / (1 + exp(-4.0 * (score - 0.5))), 6) as normed from pairs")
def norm_sigmoid(spark, d, ids=FOLDED):
    return _r(_pairs(spark, d, ids).select("a", "b", scoring.sigmoid(F.col("score"), 4.0, 0.5).alias("normed")), "normed")


_COST = f"{_PAIRS}, m as (select min(score) lo, max(score) hi from pairs), k as (select a, b, 1 - (score - lo) / (hi - lo + 1e-8) as cost from pairs, m)"


@query(f"with {_COST} select a, b, round(cost, 6) as cost from k")
def cost_matrix(spark, d, ids=FOLDED):
    return _r(scoring.costs(_pairs(spark, d, ids)), "cost")


@query(f"with {_COST}, r as (select *, row_number() over (partition by a order by cost, b) as rank from k) select a, b, round(cost, 6) as cost, rank from r where rank <= 3")
def cost_cheapest(spark, d, ids=FOLDED):
    return _r(scoring.cheapest(scoring.costs(_pairs(spark, d, ids)), 3), "cost")


_MATCH = f"""{_CH}, g as (select channel, least(a, b) as a, greatest(a, b) as b, avg(score) as score from c where a <> b group by 1, 2, 3),
p as (select a, b, round(greatest(0, least(1, sum({_w(1.0)} * score) / sum({_w(1.0)}))), 6) as score from g group by 1, 2),
e as (select a as id, b as candidate, score from p union all select b, a, score from p), r as (select *, row_number() over (partition by id order by score desc, candidate) as rank from e where score >= 0.3)"""


def _matched(spark, d, ids):
    # Rounded, so that ties don't hang on the order of a sum.
    return scoring.channel_means(_ch(spark, d, ids), _WEIGHTS).withColumn("score", _rounded("score", 6))


@query(f"with {_MATCH} select id, candidate, score, rank from r where rank <= 5")
def match_candidates(spark, d, ids=FOLDED):
    return scoring.candidates(_matched(spark, d, ids), 5, 0.3)


@query(f"""with {_MATCH}, o as (select * from r where rank <= 5), q as (select *, row_number() over (partition by id order by score desc, candidate) as k from (select a as id, b as candidate, 1 - score as score from p union all select b, a, 1 - score from p)),
u as (select id, candidate, score from o union all select id, candidate, score from q where k <= 5), m as (select id, candidate, round(avg(score), 6) as score from u group by 1, 2),
z as (select *, row_number() over (partition by id order by score desc, candidate) as rank from m) select * from z where rank <= 5""")
def match_mutual_top(spark, d, ids=FOLDED):
    """Two results, by likeness and by unlikeness, merged: means of scores, cut to 5 and ranked anew."""
    pairs = _matched(spark, d, ids)
    results = [scoring.candidates(pairs, 5, 0.3), scoring.candidates(pairs.withColumn("score", 1 - F.col("score")), 5)]
    every = [r.withColumn("score", F.round("score", 6)) for r in results]
    merged = scoring.merged_candidates(every, 5)
    return merged.withColumn("score", F.round("score", 6))


@query(f"with {_PAIRS}, n as (select count(distinct x) as n from (select a as x from pairs union all select b from pairs)) select round(avg((score = 0)::int), 6) as zeros, round(1 - count(*) filter (score > 0.5) / max(n.n * (n.n - 1)), 6) as sparsity from pairs, n")
def matrix_sparsity(spark, d, ids=FOLDED):
    return _r(scoring.sparsity(_pairs(spark, d, ids), 0.5), "zeros", "sparsity")


_HIST = "h as (select event_type as name, least(19, greatest(0, floor(value / 10)))::bigint as bin, count(*) as n from events where value is not null group by 1, 2)"


@query(f"""with {_HIST}, t as (select name, sum(n) t from h group by 1), f as (select t.name, b.bin, coalesce(n, 0) / t as p from t cross join range(20) b(bin) left join h on h.name = t.name and h.bin = b.bin),
g as (select *, sum(p) over (partition by name order by bin) as c from f)
select x.name as x, y.name as y, round(sum((x.p - y.p) ^ 2 / (x.p + y.p + 1e-12)) / 2, 6) as chi2, round(sum(abs(x.c - y.c)), 6) as emd, round(sum(least(x.p, y.p)) / sum(y.p), 6) as shared
from g x join g y on x.bin = y.bin and x.name < y.name group by 1, 2""")
def histogram_distances(spark, d):
    at = F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.col("value") / 10))).cast("long")
    hist = _t(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("name"), at.alias("bin")).agg(F.count("*").alias("n"))
    return _r(scoring.histogram_distances(hist, 20), "chi2", "emd", "shared")


@query("select greatest(0, least(3, trunc((l_partkey * 37 % 1201) / 1000.0 * 4)))::bigint as zone_x, greatest(0, least(2, trunc((l_suppkey * 61 % 1203) / 900.0 * 3)))::bigint as zone_y, count(*) as n, round(avg(l_discount), 6) as mean_score from lineitem group by 1, 2")
def layout_zones(spark, d):
    x, y = F.col("l_partkey") * 37 % 1201, F.col("l_suppkey") * 61 % 1203
    return _r(scoring.zones(_t(spark, d, "lineitem").select(x.alias("x"), y.alias("y"), F.col("l_discount").alias("score")), 1000.0, 900.0, 4, 3), "mean_score")


@query("""with t as (select p_partkey as id, (p_partkey * 37 % 1201)::double as x, (p_partkey * 61 % 1203)::double as y, p_size from part), f as (select id, x + p_size as fx, y - p_size / 3 as fy from t where p_size <> 7)
select round(avg(case when sqrt((x - fx) ^ 2 + (y - fy) ^ 2) <= 20 then 1 else 0 end), 6) as accuracy, count(*) as n from t left join f using (id)""")
def eval_placement_accuracy(spark, d):
    k = F.col("p_partkey")
    truth = _t(spark, d, "part").select(k.alias("id"), (k * 37 % 1201).cast("double").alias("x"), (k * 61 % 1203).cast("double").alias("y"), "p_size")
    found = truth.where("p_size <> 7").select("id", (F.col("x") + F.col("p_size")).alias("x"), (F.col("y") - F.col("p_size") / 3).alias("y"))
    return _r(scoring.placement_accuracy(found, truth), "accuracy")


@query("with a as (select o_orderkey as pos, o_orderpriority as item from orders), b as (select l_orderkey as pos, max(l_shipdate) as d, min(l_linestatus) as s from lineitem group by 1) select round(avg(case when item = case s when 'O' then '1-URGENT' else '5-LOW' end then 0 else 1 end), 6) as share from a join b using (pos)")
def eval_hamming(spark, d):
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("item"))
    b = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.when(F.min("l_linestatus") == "O", "1-URGENT").otherwise("5-LOW").alias("item"))
    return _r(evaluation.hamming(a, b), "share")


@query("select l_suppkey, round(exp(-2.0 * sum(case when l_discount > 0.08 then l_discount else 0 end) / count(*)), 6) as quality from lineitem group by 1")
def boundary_quality(spark, d):
    """Discounts above 0.08 are violations; all rows were checked."""
    rows = _t(spark, d, "lineitem")
    flaws = rows.where("l_discount > 0.08").select("l_suppkey", F.col("l_discount").alias("severity"))
    return _r(scoring.boundary_quality(flaws, rows.groupBy("l_suppkey").agg(F.count("*").alias("n_pairs")), ["l_suppkey"], 2.0), "quality")


@query("""with s as (select abs(corr(l_quantity, l_extendedprice)) as l_quantity, abs(corr(l_discount, l_extendedprice)) as l_discount, abs(corr(l_tax, l_extendedprice)) as l_tax from lineitem),
u as (unpivot s on l_quantity, l_discount, l_tax into name feature value strength) select feature, round(strength, 6) as strength, row_number() over (order by strength desc, feature) as rank from u""")
def feature_ranking(spark, d):
    return _r(scoring.feature_ranking(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "strength")


@query(f"""with {_SERIES.replace("value from events", "case when event_type <> 'error' then value end as value from events")}, g as (select *, last_value(value ignore nulls) {_OW}) as v0,
last_value(case when value is not null then step end ignore nulls) {_OW}) as s0, first_value(value ignore nulls) {_OW} rows between current row and unbounded following) as v1,
first_value(case when value is not null then step end ignore nulls) {_OW} rows between current row and unbounded following) as s1 from s)
select series, step, value, round(coalesce(value, case when v0 is not null and v1 is not null then v0 + (v1 - v0) * (step - s0) / (s1 - s0) end, v0, v1, 0), 6) as filled from g""")
def series_fill_gaps(spark, d):
    key = F.when(F.col("event_type") != "error", F.col("value"))
    rows = _series(spark, d, key)
    return _r(scoring.fill_gaps(rows), "filled")


@query("select event_type, round(avg(case when value <> 0 then 1 / value end), 6) as mean from events group by 1")
def stats_finite_mean(spark, d):
    # A zero stands for an infinite ratio, which the mean skips.
    ratio = F.when(F.col("value") == 0, F.lit(float("inf"))).otherwise(1 / F.nullif(F.col("value"), F.lit(0.0)))
    return _r(_t(spark, d, "events").groupBy("event_type").agg(scoring.finite_mean(ratio).alias("mean")), "mean")


@query("select range as step, round(greatest(0.01, 10.0 * pow(0.95, range)), 6) as temperature from range(100)")
def schedule_geometric(spark, d):
    return _r(scoring.schedule(spark, "geometric", 10.0, 0.01, 100), "temperature")


@query("select range as step, round(greatest(0.01, 10.0 - 9.99 * range / 99), 6) as temperature from range(100)")
def schedule_linear(spark, d):
    return _r(scoring.schedule(spark, "linear", 10.0, 0.01, 100), "temperature")


@query("select range as step, round(greatest(0.01, 10.0 * exp(-range * ln(1000) / 99)), 6) as temperature from range(100)")
def schedule_exponential(spark, d):
    return _r(scoring.schedule(spark, "exponential", 10.0, 0.01, 100), "temperature")


@query("select range as step, round(greatest(0.01, 10.0 - 9.99 * least(1.0, (range // 8) / 12)), 6) as temperature from range(100)")
def schedule_stepped(spark, d):
    return _r(scoring.schedule(spark, "stepped", 10.0, 0.01, 100, width=8), "temperature")


@query("select p_partkey, greatest(1, ceil(ln(0.5 / p_retailprice) / ln(0.9)))::bigint as steps from part")
def schedule_steps(spark, d):
    return _t(spark, d, "part").select("p_partkey", scoring.steps_to(F.col("p_retailprice"), F.lit(0.5), F.lit(0.9)).alias("steps"))


@query("select range as step, round(greatest(0.01, 0.01 + 9.99 * (1 + cos(range / 99 * pi())) / 2), 6) as temperature from range(100)")
def schedule_cosine(spark, d):
    return _r(scoring.schedule(spark, "cosine", 10.0, 0.01, 100), "temperature")


@query("with a as (select vec_id, atan2(embedding[2]::double, embedding[1]::double) as p, atan2(embedding[4]::double, embedding[3]::double) as q from embeddings where embedding is not null), t as (select vec_id, abs(p - q) as t from a) select vec_id, round(least(t, 2 * pi() - t), 6) as arc from t")
def angle_shortest_arc(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return _r(_t(spark, d, "embeddings").where("embedding is not null").select("vec_id", scoring.shortest_arc(F.atan2(e[1], e[0]), F.atan2(e[3], e[2])).alias("arc")), "arc")


@query("select l_orderkey, l_linenumber, case when 1 - l_discount * 7 >= 0.85 then 'A' when 1 - l_discount * 7 >= 0.70 then 'B' when 1 - l_discount * 7 >= 0.55 then 'C' when 1 - l_discount * 7 >= 0.40 then 'D' else 'F' end as grade from lineitem")
def confidence_grade(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.grade(1 - F.col("l_discount") * 7).alias("grade"))


@query("""select l_orderkey, l_linenumber, round(case when abs(l_quantity - 5) <= 1 then 1.0 when l_quantity > 20 then 0.0 else greatest(0.0, 1 - (abs(l_quantity - 5) - 1) / 15) end, 6) as score,
round(case when abs(l_quantity - 5) <= 1 then 0.0 when l_quantity > 20 then 2 * (l_quantity - 20 + abs(l_quantity - 5)) else 2 * (abs(l_quantity - 5) - 1) end, 6) as penalty from lineitem""")
def score_gap(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.gap_score(F.col("l_quantity"), penalty=2.0).alias("g"))
    return _r(rows.select("l_orderkey", "l_linenumber", "g.score", "g.penalty"), "score", "penalty")


@query(r"""with t as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as next from conversations where text is not null), w as (select conv_id, turn, text, next,
regexp_extract(text, '(\S+)\s*$', 1) as l, regexp_extract(next, '^\s*(\S+)', 1) as r from t where next is not null), n as (select *, regexp_full_match(l, '[a-zа-яёA-ZА-ЯЁ]{1,3}')::int + regexp_full_match(r, '[a-zа-яёA-ZА-ЯЁ]{1,3}')::int as n from w)
select conv_id, turn, (case when l = '' or r = '' then 0.5 when n = 0 then 1.0 when n = 1 then 0.5 else 0.2 end)::double as score from n""")
def text_seams(spark, d):
    rows = _t(spark, d, "conversations").where("text is not null")
    rows = rows.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return rows.select("conv_id", "turn", text.seam_score(F.col("text"), F.col("next")).alias("score"))
