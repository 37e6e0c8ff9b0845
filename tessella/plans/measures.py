"""Registered queries of layouts, metrics, normalisations, series and settings that the other modules leave, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, events, layout, ranking, registry, scoring, series, text, thresholds
from .queries import _BOX, _LOG, _OVER, _PAIRS, _SERIES, _boxes, _log, _pairs, _r, _series, _t, query

_OW = "over (partition by series order by step"


# --- layouts ---------------------------------------------------------------------------------------------------------
@query(f"""with {_BOX}, o as (select a.id as a, b.id as b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) as oy, a.x + a.w / 2 < b.x + b.w / 2 as left_of, a.y + a.h / 2 < b.y + b.h / 2 as above from box a join box b on a.id < b.id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
select a, b, ox, oy, case when ox <= oy then case when left_of then ox else -ox end else 0.0 end as dx, case when ox <= oy then 0.0 when above then oy else -oy end as dy from o""")
def layout_collisions(spark, d):
    return layout.collisions(_boxes(spark, d), 64.0)


@query(f"with {_OVER} select a, b, area from o join box p on p.id = a join box q on q.id = b where least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x) > 3 and least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y) > 3")
def layout_overlaps_tolerant(spark, d):
    return layout.overlaps(_boxes(spark, d), 64.0, 3.0)


@query(f"with {_OVER}, s as (select *, area / (sa + sb - area) as iou from o) select count(*) as n_overlaps, round(coalesce(sum(area), 0), 6) as total_area, round(coalesce(max(iou), 0), 6) as max_iou, round(coalesce(avg(iou), 0), 6) as mean_penalty, count(*) = 0 as is_valid from s where iou >= 0.05 and area >= 20")
def layout_overlap_summary(spark, d):
    boxes = _boxes(spark, d)
    return _r(layout.overlap_summary(layout.significant_overlaps(layout.rated_overlaps(boxes, 64.0), 0.05, 20.0)), "total_area", "max_iou", "mean_penalty")


@query()
def layout_merged(spark, d):
    return layout.merged(_boxes(spark, d), 64.0)


_COVER = f"""{_BOX}, g as (select distinct unnest(range(greatest(0, floor(x))::bigint, least(1200, floor(x + w))::bigint)) as i, y, h from box), k as (select distinct i, unnest(range(greatest(0, floor(y))::bigint, least(1200, floor(y + h))::bigint)) as j from g)"""


@query(f"""with {_COVER}, o as (select coalesce(sum((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))), 0) as s from box a join box b on a.id < b.id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h),
t as (select sum(w * h) as area, stddev_pop(sqrt((x + w / 2 - 600) ^ 2 + (y + h / 2 - 600) ^ 2) / (sqrt(720000) + 1e-12)) as sd, avg(h / 30) as m from box),
v as (select (select count(*) from k) / 1440000.0 as coverage, least(1, s / area) as overlap_ratio, greatest(0, least(1, 1 - sd)) as uniformity, m as mean_score from o, t)
select round(coverage, 6) as coverage, round(overlap_ratio, 6) as overlap_ratio, round(uniformity, 6) as uniformity, round(mean_score, 6) as mean_score, round(greatest(0, least(1, (coverage + 0.5 * uniformity + mean_score - overlap_ratio) / (3.5 + 1e-12))), 6) as total from v""")
def layout_total_score(spark, d):
    boxes = _boxes(spark, d).withColumn("score", F.col("h") / 30)
    return _r(layout.layout_score(boxes, 1200, 1200, 64.0), "coverage", "overlap_ratio", "uniformity", "mean_score", "total")


@query("""with q as (select p_brand, avg((p_size > 10)::int) as density, avg(p_size / 50.0) as coverage, sum(p_retailprice) as overlap from part group by 1), s as (select p_brand, greatest(0, least(1, 0.4 * density + 0.4 * coverage + 0.2 * (1 - least(1, overlap / 200000)))) as q from q)
select p_brand, round(q, 6) as quality, round(case when max(q) over () - min(q) over () < 1e-8 then 1 else (q - min(q) over ()) / (max(q) over () - min(q) over ()) end, 6) as normed from s""")
def layout_placement_quality(spark, d):
    sums = _t(spark, d, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 10).cast("int")).alias("density"), F.avg(F.col("p_size") / 50).alias("coverage"), F.sum("p_retailprice").alias("overlap"))
    rated = sums.select("p_brand", layout.placement_quality(F.col("density"), F.col("coverage"), F.col("overlap"), 200_000.0).alias("quality"))
    return _r(thresholds.minmax(rated, "quality", 1.0), "quality", "normed")


@query("with z as (select greatest(0, least(3, trunc((l_partkey * 37 % 1201) / 1000.0 * 4)))::bigint as zx, greatest(0, least(2, trunc((l_suppkey * 61 % 1203) / 900.0 * 3)))::bigint as zy, l_discount as s from lineitem) select round(greatest(0, least(1, avg(s) * count(distinct (zx, zy)) / 12)), 6) as score from z")
def layout_mapping_score(spark, d):
    x, y = F.col("l_partkey") * 37 % 1201, F.col("l_suppkey") * 61 % 1203
    zoned = scoring.zones(_t(spark, d, "lineitem").select(x.alias("x"), y.alias("y"), F.col("l_discount").alias("score")), 1000.0, 900.0, 4, 3)
    return _r(scoring.mapping_score(zoned, 4, 3), "score")


@query(f"""with {_BOX}, s as (select count(distinct id) / count(*) as u, count(*) as n, sum(w * h) as area from box), p as (select count(*) as k from (select distinct x, y from box)), o as (select coalesce(sum((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))), 0) as v from box a join box b on a.id < b.id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
select 'finite' as validator, 1.0::double as score union all select 'overlap', round(1 - least(1, v / area), 6) from o, s union all select 'placement', round(k / n, 6) from p, s union all select 'unique', u from s""")
def validator_suite(spark, d):
    return _r(registry.validated(_boxes(spark, d)), "score")


# --- metrics ---------------------------------------------------------------------------------------------------------
@query("""with p as (select distinct least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_returnflag = 'A'), t as (select distinct least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b from lineitem where l_linestatus = 'F'), h as (select count(*) n from p join t using (a, b)),
m as (select h.n / (select count(*) from p) as p, h.n / (select count(*) from t) as r from h) select round(p, 6) as precision, round(r, 6) as recall, round(5 * p * r / (4 * p + r), 6) as fbeta from m""")
def eval_f_beta(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag", "l_linestatus")
    return _r(evaluation.f_beta(rows.where("l_returnflag = 'A'"), rows.where("l_linestatus = 'F'"), 2.0), "precision", "recall", "fbeta")


@query("""with o as (select p_partkey as id, row_number() over (order by p_retailprice, p_partkey) - 1 as pos, row_number() over (order by p_name, p_partkey) - 1 as rank from part), k as (select count(*) as distance from o x join o y on x.pos < y.pos and x.rank > y.rank), n as (select count(*) as n from o)
select n, distance, round((1 - 2 * distance / (n * (n - 1) / 2) + 1) / 2, 6) as score from k, n""")
def eval_kendall(spark, d):
    """Parts by price against parts by name."""
    place = lambda c: _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.row_number().over(Window.orderBy(c, "p_partkey")) - 1).cast("long").alias("pos"))
    return _r(evaluation.kendall(place("p_retailprice"), place("p_name")), "score")


_PLACES = "t as (select p_partkey as id, (p_partkey * 37 % 1201)::double as x, (p_partkey * 61 % 1203)::double as y, (p_partkey % 7) / 10.0::double as angle from part), p as (select id, x + id % 45 as x, y - id % 30 as y, angle + (id % 11) / 40.0::double as angle from t where id % 9 <> 0)"


@query(f"""with {_PLACES}, f as (select min(id) as f from p), q as (select p.*, t.x as tx, t.y as ty, t.angle as ta from p join t using (id)), o as (select q.* from q, f where id = f),
r as (select q.id, cos(o.angle) * (q.x - o.x) + sin(o.angle) * (q.y - o.y) as pu, cos(o.angle) * (q.y - o.y) - sin(o.angle) * (q.x - o.x) as pv, cos(o.ta) * (q.tx - o.tx) + sin(o.ta) * (q.ty - o.ty) as tu, cos(o.ta) * (q.ty - o.ty) - sin(o.ta) * (q.tx - o.tx) as tv, abs(degrees((q.angle - o.angle) - (q.ta - o.ta))) % 360 as t from q, o),
e as (select *, sqrt((pu - tu) ^ 2 + (pv - tv) ^ 2) as e, least(t, 360 - t) as g from r), n as (select count(*) as n_pairs, coalesce(sum((sqrt((a.pu - b.pu) ^ 2 + (a.pv - b.pv) ^ 2) < 120)::int), 0) as n_kept from r a join r b on a.id < b.id and sqrt((a.tu - b.tu) ^ 2 + (a.tv - b.tv) ^ 2) < 90)
select count(*) as n_fragments, round(avg((e < 30 and g < 10)::int), 6) as direct, round(avg((e < 30)::int), 6) as edge_match_rate, round(sqrt(avg(e * e)), 6) as rmse, round(avg(g), 6) as mean_turn, max(n_pairs) as n_pairs, max(n_kept)::bigint as n_kept, round(max(case when n_pairs = 0 then 1 else n_kept / n_pairs end), 6) as neighbors from e, n""")
def eval_reconstruction(spark, d):
    k = F.col("p_partkey")
    truth = _t(spark, d, "part").select(k.alias("id"), (k * 37 % 1201).cast("double").alias("x"), (k * 61 % 1203).cast("double").alias("y"), (k % 7 / 10).alias("angle"))
    found = truth.where("id % 9 <> 0").select("id", (F.col("x") + F.col("id") % 45).alias("x"), (F.col("y") - F.col("id") % 30).alias("y"), (F.col("angle") + F.col("id") % 11 / 40).alias("angle"))
    return _r(evaluation.reconstruction(found, truth), "direct", "edge_match_rate", "rmse", "mean_turn", "neighbors")


@query("select distinct doc_id as id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def eval_missing(spark, d):
    ids = lambda t: _t(spark, d, t).select(F.col("doc_id").alias("id"))
    return evaluation.missing(ids("documents"), ids("labels"))


@query("with o as (select user_id as key, max(value) as value from events where event_type = 'click' group by 1), n as (select user_id as key, max(value) as value from events where event_type = 'error' group by 1) select key, o.value as old, n.value as new, case when o.key is null then 'added' when n.key is null then 'removed' else 'changed' end as change from o full join n using (key) where o.value is distinct from n.value")
def settings_diff(spark, d):
    top = lambda kind: _t(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("value"))
    return evaluation.changed_keys(top("click"), top("error"))


@query("with e as (select l_shipdate, l_returnflag as metric, l_discount * 10 as value, l_quantity as weight from lineitem), s as (select l_shipdate, greatest(0, least(1, sum(case metric when 'A' then 2 when 'N' then 0 else weight end * value) / (sum(case metric when 'A' then 2 when 'N' then 0 else weight end) + 1e-12))) as total, count(*) as n_metrics from e group by 1) select l_shipdate, round(total, 6) as total, n_metrics, total >= 0.5 as passed from s where abs(total - 0.5) > 1e-9")
def report_summary(spark, d):
    """Totals that lie on the threshold itself hang on the order of a sum and are left to a test."""
    entries = _t(spark, d, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("metric"), (F.col("l_discount") * 10).alias("value"), F.col("l_quantity").alias("weight"))
    return _r(scoring.report(entries, ["l_shipdate"], {"A": 2.0, "N": 0.0}).where("abs(total - 0.5) > 1e-9"), "total")


@query("select l_orderkey, l_linenumber, round((1.5 * l_discount * 10 + l_tax * 10 + 0.8 * l_quantity / 50 + 1.2 * (1 - l_tax) + 1.0 * l_linenumber / 7) / 5.5, 6) as total from lineitem")
def confidence_total(spark, d):
    parts = [F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, 1 - F.col("l_tax"), F.col("l_linenumber") / 7]
    return _r(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.confidence(parts).alias("total")), "total")


@query("""with a as (select c_nationkey, round(c_acctbal / 30, 3) as x, row_number() over () as k from customer), p as (select a.c_nationkey, count(*) as n, count(*) filter (abs(a.x - b.x) <= 5) as m from a join a b on a.c_nationkey = b.c_nationkey and a.k < b.k group by 1)
select c_nationkey, round(coalesce(m / n, 1), 6) as agreement from (select distinct c_nationkey from a) left join p using (c_nationkey)""")
def angle_group_agreement(spark, d):
    rows = _t(spark, d, "customer").select("c_nationkey", F.round(F.col("c_acctbal") / 30, 3).alias("x"))
    return _r(scoring.angle_agreement(rows, ["c_nationkey"], "x"), "agreement")


@query("""with e as (select vec_id, atan2(embedding[2]::double, embedding[1]::double) as p from embeddings where embedding is not null), w as (select vec_id, case when p < 0 then p + 2 * pi() else p end as p from e),
c as (select vec_id, p, c, row_number() over (partition by vec_id order by least((p - c + 4 * pi()) % (2 * pi()), 2 * pi() - (p - c + 4 * pi()) % (2 * pi())), c) as k from w, (values (0.0), (1.5), (3.0), (4.5)) t(c)) select vec_id, round(p, 6) as angle, c::double as nearest from c where k = 1""")
def angle_nearest(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(2)]
    turn = scoring.wrapped(F.atan2(e[1], e[0]))
    return _r(_t(spark, d, "embeddings").where("embedding is not null").select("vec_id", turn.alias("angle"), scoring.nearest_angle(turn, [0.0, 1.5, 3.0, 4.5]).alias("nearest")), "angle")


@query("""with h as (select (event_type = 'click') as src, least(31, greatest(0, floor(value / 8)))::bigint as level, count(*) as n from events where value is not null and event_type in ('click', 'view') group by 1, 2), g as (select i as level, coalesce(a.n, 0) as s, coalesce(b.n, 0) as t from range(32) r(i) left join h a on a.level = i and a.src left join h b on b.level = i and not b.src),
c as (select level, sum(s) over (order by level) / (sum(s) over () + 1e-12) as cs, sum(t) over (order by level) / (sum(t) over () + 1e-12) as ct from g) select x.level, coalesce(min(y.level), 31) as mapped from c x left join c y on y.ct >= x.cs group by 1""")
def histogram_specified(spark, d):
    at = F.least(F.lit(31), F.greatest(F.lit(0), F.floor(F.col("value") / 8))).cast("long").alias("level")
    hist = lambda kind: _t(spark, d, "events").where(F.col("value").isNotNull() & (F.col("event_type") == kind)).groupBy(at).agg(F.count("*").alias("n"))
    return scoring.specified_levels(hist("click"), hist("view"), 32)


# --- normalisations --------------------------------------------------------------------------------------------------
@query("select o_orderkey, round(-1 + 2 * (o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 6) as normed from orders")
def norm_minmax_range(spark, d):
    return _r(thresholds.minmax(_t(spark, d, "orders"), "o_totalprice", low=-1.0, high=1.0).select("o_orderkey", "normed"), "normed")


@query(f"with {_PAIRS} select a, b, round((score - avg(score) over ()) / stddev_pop(score) over (), 6) as normed from pairs")
def norm_matrix_zscore(spark, d):
    return _r(thresholds.matrix_zscore(_pairs(spark, d), "score").select("a", "b", "normed"), "normed")


@query(f"with {_PAIRS} select a, b, round((score - min(score) over ()) / (max(score) over () - min(score) over ()), 6) as normed from pairs")
def norm_matrix_minmax(spark, d):
    return _r(thresholds.matrix_minmax(_pairs(spark, d), "score").select("a", "b", "normed"), "normed")


@query(f"with {_PAIRS} select a, b, round(exp(score / 0.5) / sum(exp(score / 0.5)) over (), 9) as over_all, round(exp(score / 0.5) / sum(exp(score / 0.5)) over (partition by b), 9) as over_columns from pairs")
def norm_softmax_axes(spark, d):
    rows = thresholds.softmax(_pairs(spark, d), "score", [], 0.5, "over_all")
    return thresholds.softmax(rows, "score", ["b"], 0.5, "over_columns").select("a", "b", F.round("over_all", 9).alias("over_all"), F.round("over_columns", 9).alias("over_columns"))


@query(f"with {_PAIRS}, s as (select a, b, score - 0.4 as score from pairs), w as (select *, sum(score) over p as s, sum(abs(score)) over p as l1, sqrt(sum(score * score) over p) as l2, min(score) over p as lo, max(score) over p as hi from s window p as (partition by a)) select a, b, round(case when l1 < 1e-12 then 0 else score / l1 end, 6) as l1, round(case when l2 < 1e-12 then 0 else score / l2 end, 6) as l2, round(case when hi - lo < 1e-12 then 0 else (score - lo) / (hi - lo) end, 6) as span from w")
def norm_row_forms(spark, d):
    rows = _pairs(spark, d).withColumn("score", F.col("score") - 0.4)
    for how, name in (("l1", "l1"), ("l2", "l2"), ("minmax", "span")):
        rows = thresholds.row_normalise(rows, "score", ["a"], how, name)
    return _r(rows.select("a", "b", "l1", "l2", "span"), "l1", "l2", "span")


@query(f"with {_PAIRS}, s as (select a, sum(score) as s from pairs group by 1) select pairs.a, b, round(score / s, 6) as normed from pairs join s on s.a = pairs.a")
def norm_row_sum(spark, d):
    return _r(thresholds.row_normalise(_pairs(spark, d), "score", ["a"], "sum").select("a", "b", "normed"), "normed")


@query("""with r as (select o_totalprice as v, row_number() over (order by o_totalprice) - 1 as k, count(*) over () as m from orders), s as (select event_id, value, (count(*) over (order by value)) / (count(*) over ()) as q from events where value is not null)
select event_id, value, v as calibrated from s join r on k = floor(q * (m - 1))""")
def norm_calibrated(spark, d):
    """Event values moved to the distribution of order prices."""
    rows = _t(spark, d, "events").where("value is not null").select("event_id", "value")
    return thresholds.calibrated(rows, "value", _t(spark, d, "orders"), "o_totalprice")


@query("""with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders), h as (select least(255, floor((o_totalprice - lo) / (hi - lo) * 256))::int as bin, count(*) as n from orders, s group by 1), g as (select i::int as bin, lo, hi, coalesce(n, 0)::double as n from range(256) r(i) cross join s left join h on h.bin = i),
c as (select *, sum(n) over (order by bin) w1, sum(n * (lo + (bin + 0.5) * (hi - lo) / 256)) over (order by bin) s1, sum(n) over () w, sum(n * (lo + (bin + 0.5) * (hi - lo) / 256)) over () s from g),
v as (select *, case when w1 > 0 and w > w1 then w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) ^ 2 else 0 end as v from c), b as (select lo, hi, list(bin order by bin) as l from v where v >= (select max(v) from v) * (1 - 1e-10) group by lo, hi)
select round((lo + (l[len(l) // 2 + 1] + 1) * (hi - lo) / 256 + (select quantile_cont(o_totalprice, 0.5) from orders)) / 2, 6) as threshold from b""")
def threshold_adaptive(spark, d):
    return _r(thresholds.adaptive(_t(spark, d, "orders"), "o_totalprice"), "threshold")


@query("select event_type, round(sum(value * user_id) / sum(user_id), 6) as mean, round(sqrt(greatest(0, sum(value * value * user_id) / sum(user_id) - (sum(value * user_id) / sum(user_id)) ^ 2)), 4) as std from events where value is not null group by 1")
def stats_weighted(spark, d):
    rows = series.weighted_moments(_t(spark, d, "events").where("value is not null"), ["event_type"], "user_id")
    return rows.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c) select user_id, event_type, n from r where k = 1")
def stats_mode(spark, d):
    return series.mode(_t(spark, d, "events"), ["user_id"], "event_type")


@query("select event_id, event_type, value, round(100.0 * (rank() over (partition by event_type order by value) - 1) / count(*) over (partition by event_type), 6) as percent from events")
def stats_percent_rank(spark, d):
    return _r(series.percentile_rank(_t(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"]), "percent")


@query("with s as (select avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_tax) mt, stddev_pop(l_tax) st from lineitem) select l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) as l_quantity, round((l_tax - mt) / st, 6) as l_tax from lineitem, s")
def feature_normalised(spark, d):
    return _r(scoring.normalised_features(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]), "l_quantity", "l_tax")


@query("""with r as (select count(*) / (count(*) - 1) as f, corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_quantity, l_tax) c, corr(l_extendedprice, l_discount) d, corr(l_extendedprice, l_tax) e, corr(l_discount, l_tax) g from lineitem), k as (select abs(a * f) > 0.3 as p, abs(b * f) > 0.3 as q, abs(c * f) > 0.3 as t, abs(d * f) > 0.3 as u, abs(e * f) > 0.3 as v, abs(g * f) > 0.3 as w from r),
z as (select true as f0, not p as f1, not q and not (not p and u) as f2, t, v, p, w from k) select 'l_quantity' as feature, f0 as kept from z union all select 'l_extendedprice', f1 from z union all select 'l_discount', f2 from z union all select 'l_tax', not t and not (f1 and v) and not (f2 and w) from z""")
def feature_uncorrelated(spark, d):
    return scoring.correlated_features(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.3)


@query(f"with {_PAIRS}, r as (select a, b, score, row_number() over (partition by a order by score desc, b) as rank from pairs where a <> b and score > 0) select * from r where rank <= 4")
def matrix_best_per_row(spark, d):
    return scoring.best_per_row(_pairs(spark, d), 4)


@query(f"with {_PAIRS} select a, b, round(1 / (1 + score), 6) as inverse, round(exp(-(score ^ 2) / 0.5), 6) as gaussian from pairs order by score, a, b limit 50")
def matrix_similarities(spark, d):
    """The 50 closest pairs, their distances as similarities."""
    near = _pairs(spark, d).orderBy("score", "a", "b").limit(50)
    return _r(near.select("a", "b", V.similarity_of(F.col("score")).alias("inverse"), V.similarity_of(F.col("score"), 0.5).alias("gaussian")), "inverse", "gaussian")


# --- series ----------------------------------------------------------------------------------------------------------
@query(f"""with {_SERIES}, n as (select series, max(step) as n from s group by 1), i as (select series, step, unnest(range(step - 4, step + 4)) as place from s join n using (series) where n > 4), m as (select i.series, i.step, case when place < 1 then 2 - place when place > n then 2 * n - place else place end as place from i join n using (series)),
v as (select m.series, m.step, avg(value) as rolling from m join s on s.series = m.series and s.step = m.place group by 1, 2) select s.*, round(rolling, 6) as rolling from s left join v using (series, step)""")
def series_reflected_mean(spark, d):
    return _r(series.reflected_mean(_series(spark, d), 8), "rolling")


@query(f"""with {_SERIES}, n as (select series, max(step) n from s group by 1), w as (select series, unnest(range(0, ((n - 8) // 4 + 1)::bigint)) as k from n where n >= 8), p as (select s.series, step, k, value + k as value from w join s on s.series = w.series and step > k * 4 and step <= k * 4 + 8),
m as (select series, step, avg(value) as merged from p group by 1, 2) select s.series, s.step, round(coalesce(merged, 0), 6) as merged from s left join m using (series, step)""")
def series_overlap_add(spark, d):
    """Each window's rows raised by its number, then put together again."""
    rows = _series(spark, d)
    parts = series.split(rows, 8, 4).withColumn("value", F.col("value") + F.col("window"))
    return _r(series.overlap_add(parts, rows.groupBy("series").agg(F.max("step").alias("n"))), "merged")


@query(f"""with {_SERIES}, n as (select series, max(step) as n from s group by 1), i as (select series, step, unnest(range(step - 2, step + 3)) as place from s), m as (select i.series, i.step, greatest(1, least(n, place)) as place from i join n using (series))
select m.series, m.step, any_value(t.value) as value, median(s.value) as smooth from m join s on s.series = m.series and s.step = m.place join s t on t.series = m.series and t.step = m.step group by 1, 2""")
def series_edge_padded_median(spark, d):
    return series.edge_padded_median(_series(spark, d), 5)


@query(f"with recursive {_SERIES}, r as (select series, step, value, value as smooth from s where step = 1 union all select s.series, s.step, s.value, 0.3 * s.value + 0.7 * r.smooth from r join s on s.series = r.series and s.step = r.step + 1) select series, step, value, round(smooth, 6) as smooth from r")
def series_ewma(spark, d):
    return _r(series.ewma(_series(spark, d)), "smooth")


@query(f"""with recursive {_SERIES}, f as (select *, lag(value) {_OW}) l, lead(value) {_OW}) r from s), p as (select series, step, value from f where value > l and value > r and value >= 20),
k as (select series, min(step) as step from p group by 1 union all select k.series, (select min(step) from p where p.series = k.series and p.step >= k.step + 5) from k where k.step is not null) select p.* from k join p on p.series = k.series and p.step = k.step""")
def series_spaced_peaks(spark, d):
    return series.peaks(_series(spark, d), 20.0, 5)


@query(f"with {_SERIES}, i as (select *, step - row_number() {_OW}) as k from s where value >= 40) select series, min(step) as begin, max(step) + 1 as \"end\", count(*) as n from i group by series, k")
def series_half_open_segments(spark, d):
    return series.segments(_series(spark, d), F.col("value") >= 40, True)


# --- events and texts ------------------------------------------------------------------------------------------------
@query(f"with {_LOG} select event_id, user_id, name, level, ts, value from log where ts >= (select max(ts) - interval 2 day from log)")
def event_since(spark, d):
    log = _log(spark, d)
    newest = log.agg((F.max("ts") - F.expr("interval 2 days")).cast("string").alias("t")).first()["t"]
    return events.since(log, newest)


@query(f"with {_LOG} select event_id, user_id, name, level, ts, value from log where level <> 'info'")
def event_merged_logs(spark, d):
    log = _log(spark, d)
    return events.merged([log.where("level = 'debug'"), log.where("level in ('debug', 'warning')"), log.where("level in ('error', 'critical')")])


@query(f"with {_LOG}, f as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from log where ts >= (select max(ts) - interval 5 day from log)) select event_id, user_id, name, level, ts, value from f where k <= 20")
def event_alive(spark, d):
    log = _log(spark, d)
    return events.alive(log, log.agg(F.max("ts").cast("string").alias("t")).first()["t"], 5 * 86_400, 20, ["user_id"])


@query()
def text_cleaned(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", text.cleaned(F.col("text"), True, True).alias("cleaned"))


@query("select item_id, length(text)::bigint as result, true as success, 0::bigint as retries from benchmark")
def batch_applied(spark, d):
    rows = registry.applied(_t(spark, d, "benchmark").select("item_id", "text"), "text", len, "long", 1)
    return rows.select("item_id", "result", "success", "retries")


@query("""with p as (select l_suppkey, l_partkey, vote, l_suppkey as voter, (l_partkey * 37 % 1201)::double as x, (l_partkey * 61 % 1203)::double as y from (select distinct l_suppkey, l_partkey, 1 as vote from lineitem where l_suppkey <= 40) t),
n as (select a.l_partkey as a, b.l_partkey as b, count(distinct a.voter) as votes from p a join p b on a.voter = b.voter and a.l_partkey < b.l_partkey and sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) < 60 group by 1, 2) select a, b, votes from n where votes >= 2""")
def pair_consensus(spark, d):
    """Suppliers 1 to 40 as the voters that the comparison is made of; each places its parts."""
    k = F.col("l_partkey")
    placed = _t(spark, d, "lineitem").where("l_suppkey <= 40").select(F.col("l_suppkey").alias("voter"), k.alias("id"), (k * 37 % 1201).cast("double").alias("x"), (k * 61 % 1203).cast("double").alias("y")).distinct()
    voters = placed.select("voter").distinct().count()
    return ranking.consensus(placed, 60.0, 2 / max(2, voters))
