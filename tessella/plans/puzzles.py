"""Registered queries of pair matrices, solvers, graphs, clusters and curves, each with its SQL where SQL can say it.

Fragments are nations and assemblies their regions; a fragment's edges are its market segments, with the curve of mean order prices
by month. Graphs join the nations of customers and suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, clusters, curves, graphs, ranking, registry, scoring
from .queries import _BOX, _boxes, _pairs, _r, _rounded, _rounded_quickly, _series, _t, query
from .scoring import _COST

# The market segments, in the order of their edges.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("fragment_id"), F.col("n_regionkey").cast("long").alias("assembly"))
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("fragment_id"))
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("long")
    edge = F.col("fragment_id") * 8 + F.coalesce(segment, F.lit(0))
    by_month = rows.groupBy("assembly", "fragment_id", edge.alias("edge_id"), F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice") / 1e5, 6).alias("y"), F.count("*").alias("n"))
    listed = by_month.groupBy("assembly", "fragment_id", "edge_id").agg(F.array_sort(F.collect_list(F.struct("m", "y", "n"))).alias("p"))
    y = F.transform("p", lambda p: p["y"])
    curve = F.transform("p", lambda p: F.array(p["m"] / 12, p["y"]))
    return listed.select(
        "assembly", "fragment_id", "edge_id", curve.alias("curve"), F.transform("p", lambda p: p["n"].cast("double")).alias("css"), F.slice(y, 1, 6).alias("ifs"),
        (1 + F.array_max(y) - F.array_min(y)).alias("fd"), F.aggregate("p", F.lit(0.0), lambda s, p: s + p["n"]).alias("length"),
    )


@query()
def matrix_entries(spark, d):
    """All nations' edges in one assembly: the upper triangle of the whole matrix."""
    rows = assembly.entries(_edges(spark, d).withColumn("assembly", F.lit(0).cast("long")))
    return _r(rows, "score", "css_sim", "dtw_dist", "fd_diff")


@query()
def matrix_top_candidates(spark, d):
    return _r(assembly.top_candidates(assembly.entries(_edges(spark, d)), 5), "score")


def _solved(spark: SparkSession, d: str, method: str, **options) -> DataFrame:
    edges = _edges(spark, d)
    return _r(assembly.solve(edges, assembly.entries(edges), method, **options), "x", "y", "angle", "total")


@query()
def assembly_greedy(spark, d):
    return _solved(spark, d, "greedy")


@query()
def assembly_beam(spark, d):
    return _solved(spark, d, "beam")


@query()
def assembly_annealing(spark, d):
    return _solved(spark, d, "annealing", rounds=1500)


@query()
def assembly_exhaustive(spark, d):
    return _solved(spark, d, "exhaustive")


@query()
def matcher_scores(spark, d):
    """Every registered matcher on all pairs of edges of a region."""
    edges = _edges(spark, d)
    side = lambda s: edges.select("assembly", *[F.col(c).alias(f"{c}_{s}") for c in edges.columns if c != "assembly"])
    pairs = side("x").join(side("y"), "assembly").where("edge_id_x < edge_id_y and fragment_id_x <> fragment_id_y")
    names = sorted(registry.MATCHERS)
    return _r(registry.matched(pairs, names).select("edge_id_x", "edge_id_y", *names), *names)


# --- pairs -----------------------------------------------------------------------------------------------------------
@query()
def pair_filter_chain(spark, d):
    """Score, inliers, best of a pair, at most 5 per fragment, at most 100."""
    inliers = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).agg(F.count("*").alias("n_inliers"))
    pairs = _pairs(spark, d, ("l_suppkey * 2", "l_partkey * 2 + 1")).join(inliers, ["a", "b"])
    return ranking.filter_pairs(pairs, 0.4, 2)


@query()
def pair_degree_cap(spark, d):
    return ranking.capped_per_fragment(ranking.dedup_keep_best(_pairs(spark, d)), 3)


@query("""with p as (select least(l_suppkey * 2, l_partkey * 2 + 1) as a, greatest(l_suppkey * 2, l_partkey * 2 + 1) as b, round(avg(l_discount) * 10, 6) as score from lineitem group by 1, 2)
select a, b, score, row_number() over (order by score desc, a, b) - 1 as rank from p where score >= 0.2""")
def pair_rank_from_zero(spark, d):
    rows = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).agg(F.round(F.avg("l_discount") * 10, 6).alias("score"))
    return ranking.rank_pairs(rows, 0.2, 0, 0)


@query(f"with {_COST}, b as (select a, b, case when a = b then 0 else 0.75 * cost + 0.25 * (1 - cost) end as cost from k) select a, b, round(cost, 6) as cost from b")
def cost_combined(spark, d):
    cost = scoring.costs(_pairs(spark, d))
    two = cost.select(F.lit("x").alias("name"), "a", "b", "cost").union(cost.select(F.lit("y"), "a", "b", 1 - F.col("cost")))
    return _r(scoring.combined_costs(two, {"x": 3.0, "y": 1.0}), "cost")


@query(f"with {_COST}, o as (select min(cost) c0, max(cost) c1 from k where a <> b) select a, b, round((cost - c0) / (c1 - c0), 6) as cost from k, o where a <> b")
def cost_normalised_minmax(spark, d):
    return _r(scoring.normalised_costs(scoring.costs(_pairs(spark, d))), "cost")


@query(f"with {_COST}, o as (select avg(cost) u, stddev_pop(cost) s from k where a <> b), z as (select a, b, greatest(0, (cost - u) / s) as cost from k, o where a <> b) select a, b, round(cost / (select max(cost) from z), 6) as cost from z")
def cost_normalised_zscore(spark, d):
    return _r(scoring.normalised_costs(scoring.costs(_pairs(spark, d)), "zscore"), "cost")


@query(f"with {_COST}, c as (select a, b, round(cost, 9) as cost from k where a <> b) select a, b, round((row_number() over (order by cost, a, b) - 1) / (count(*) over () - 1), 6) as cost from c")
def cost_normalised_rank(spark, d):
    cost = scoring.costs(_pairs(spark, d)).withColumn("cost", F.round("cost", 9))
    return _r(scoring.normalised_costs(cost, "rank"), "cost")


@query(f"""with {_COST}, p as (select distinct a as id from k where a % 3 <> 0), j as (select a, b from k where cost < 0.5 union select b, a from k where cost < 0.5), n as (select j.a as id, avg(coalesce(k.cost, 0)) as m, count(*) as n from j join p on p.id = j.b left join k on k.a = j.a and k.b = j.b group by 1)
select id, round(case when n is null then 0.5 else greatest(0, least(1, m)) end, 6) as local_score, coalesce(n, 0) as n_neighbors, coalesce(n, 0) >= 2 as reliable from p left join n using (id)""")
def fragment_local_scores(spark, d):
    """Placed fragments are those not divisible by 3; neighbours are pairs that cost less than 0.5."""
    cost = scoring.costs(_pairs(spark, d))
    placed = cost.select(F.col("a").alias("id")).distinct().where("id % 3 <> 0")
    return _r(assembly.fragment_scores(placed, cost.where("cost < 0.5"), cost, 2), "local_score")


# --- graphs of nations -----------------------------------------------------------------------------------------------
_NET = """n as (select least(c_nationkey, s_nationkey)::bigint as a, greatest(c_nationkey, s_nationkey)::bigint as b, round(avg(l_extendedprice) / 1e4, 6) as score from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
where c_nationkey <> s_nationkey group by 1, 2)"""


def _net(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    a, b = F.least("c_nationkey", "s_nationkey").cast("long"), F.greatest("c_nationkey", "s_nationkey").cast("long")
    return rows.groupBy(a.alias("a"), b.alias("b")).agg(F.round(F.avg("l_extendedprice") / 1e4, 6).alias("score"))


@query(f"with {_NET}, e as (select a, b, score as w from n where score > 2.5 union all select b, a, score from n where score > 2.5) select a as id, count(*) as degree, round(sum(w), 6) as strength from e group by 1")
def graph_degrees(spark, d):
    return _r(graphs.degrees(graphs.build(_net(spark, d), 2.5)), "strength")


@query(f"with recursive {_NET}, e as (select a, b from n where score > 2.9 union all select b, a from n where score > 2.9), r(a, b) as (select distinct a, a from e union select r.a, e.b from r join e on r.b = e.a) select a as node, min(b) as component from r group by 1")
def graph_components(spark, d):
    return graphs.connected(graphs.build(_net(spark, d), 2.9))


@query(f"""with recursive {_NET}, r(x, y, w, place) as (select a, b, score, a from n union select r.x, r.y, r.w, case when r.place = n.a then n.b else n.a end from r join n on (n.a = r.place or n.b = r.place) and (n.score, n.a, n.b) < (r.w, r.x, r.y))
select a, b, score as weight from n where not exists (select 1 from r where r.x = n.a and r.y = n.b and r.place = n.b)""")
def graph_spanning_forest(spark, d):
    """In SQL: an edge belongs to it unless lighter edges join its ends."""
    return graphs.spanning_forest(graphs.build(_net(spark, d)))


def _doubled(n: int) -> str:
    steps = ", ".join(f"d{k + 1} as (select x.a, y.b, min(x.d + y.d) as d from d{k} x join d{k} y on x.b = y.a group by 1, 2)" for k in range(n))
    return f"e as (select a, b, score as d from n union all select b, a, score from n), d0 as (select a, b, d from e union all select distinct a, a, 0.0 from e), {steps}"


@query(f"with {_NET}, {_doubled(5)} select a as source, b as id, round(d, 6) as distance from d5")
def graph_shortest_paths(spark, d):
    edges = graphs.build(_net(spark, d))
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return _r(graphs.shortest_paths(edges, ids).select("source", "id", "distance"), "distance")


# --- clusters and places ---------------------------------------------------------------------------------------------
_POINTS = "p as (select c_custkey as id, round(c_acctbal / 1000, 4) as x, c_nationkey::double as y from customer)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(_rounded(F.col("c_acctbal") / 1000, 4), F.col("c_nationkey").cast("double")).alias("x"))


def _rounds(n: int) -> str:
    """Rounds of k-means from four fixed centres."""
    out = ["k0 as (select * from (values (0, 0.0, 0.0), (1, 5.0, 8.0), (2, 2.0, 16.0), (3, 8.0, 24.0)) t(i, cx, cy))"]
    for r in range(n):
        out.append(f"a{r} as (select id, x, y, arg_min(i, ((x - cx) ^ 2 + (y - cy) ^ 2, i)) as i from p, k{r} group by id, x, y)")
        out.append(f"k{r + 1} as (select k.i, coalesce(avg(x), min(cx)) as cx, coalesce(avg(y), min(cy)) as cy from k{r} k left join a{r} a on a.i = k.i group by k.i)")
    return ", ".join(out)


@query(f"with {_POINTS}, {_rounds(4)} select id, i as cluster from a3")
def cluster_kmeans(spark, d):
    return clusters.kmeans(_points(spark, d), [[0.0, 0.0], [5.0, 8.0], [2.0, 16.0], [8.0, 24.0]], 4, 0.0)[0].select("id", "cluster")


@query(f"""with {_POINTS}, q as (select id as qid, x as qx, y as qy, y % 5 as own from p where id % 20 = 0), m as (select qid, own, y % 5 as c, avg(sqrt((x - qx) ^ 2 + (y - qy) ^ 2)) as m from p join q on id <> qid group by 1, 2, 3),
s as (select qid, coalesce(max(m) filter (c = own), 0) as a, min(m) filter (c <> own) as b from m group by 1) select qid as id, round(case when b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from s""")
def cluster_silhouette(spark, d):
    """Of every customer whose id is divisible by 20, the stated query set, among all."""
    points = _points(spark, d).withColumn("cluster", F.get("x", F.lit(1)) % 5)
    return _r(clusters.silhouette(points, points.where("id % 20 = 0")), "silhouette")


@query(f"with {_BOX}, r as (select a.id, b.id as other, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 6) as d, row_number() over (partition by a.id order by sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), b.id) as rank from box a join box b on a.id <> b.id) select * from r where rank <= 4")
def layout_nearest(spark, d):
    boxes = _boxes(spark, d)
    return _r(clusters.nearest_places(boxes, boxes, 4, 50.0), "d")


@query(f"with recursive {_BOX}, e as (select a.id as a, b.id as b from box a join box b on a.id <> b.id and (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 < 144), r(a, b) as (select id, id from box union select r.a, e.b from r join e on r.b = e.a) select a as id, min(b) as cluster from r group by 1")
def layout_distance_clusters(spark, d):
    return clusters.distance_clusters(_boxes(spark, d), 12.0)


@query()
def track_frames(spark, d):
    """Orders by month as frames, a customer's mean price and count as its place."""
    rows = _t(spark, d, "orders").groupBy(F.month("o_orderdate").cast("long").alias("frame"), F.col("o_custkey").alias("id")).agg((F.avg("o_totalprice") / 1000).alias("x"), (F.count("*") * 10.0).alias("y"))
    return _r(clusters.tracked(rows, 2.0), "d")


# --- curves ----------------------------------------------------------------------------------------------------------
def _curves(spark: SparkSession, d: str) -> DataFrame:
    points = F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda p: F.array(p["step"].cast("double"), p["value"]))
    return _series(spark, d).groupBy("series").agg(points.alias("c"))


def _crossed(spark: SparkSession, d: str, run, results: tuple[str, ...]) -> DataFrame:
    """Users whose id is divisible by 20, the stated query set, against all others."""
    c = _curves(spark, d).withColumnRenamed("series", "name")
    return _r(curves.crossed(c.where("name % 20 = 0"), c, run, results), *results)


@query()
def curve_frechet(spark, d):
    return _crossed(spark, d, lambda xs, ys: {"frechet": curves.frechet_block(xs, ys, 32)}, ("frechet",))


@query()
def curve_rotation_dtw(spark, d):
    edges = _edges(spark, d)
    side = lambda s: edges.select("assembly", F.col("edge_id").alias("edge_" + s), F.col("curve").alias("curve_" + s))
    pairs = side("x").join(side("y"), "assembly").where("edge_x < edge_y").withColumn("t", curves.best_turn("curve_x", "curve_y", 12, 16, 10, True))
    return _r(pairs.select("edge_x", "edge_y", "t.distance", "t.degrees", "t.mirrored"), "distance", "degrees")


@query()
def curve_divider_dimension(spark, d):
    return _r(_curves(spark, d).select("series", curves.divider("c").alias("fd")), "fd")


@query()
def curve_css_similarity(spark, d):
    """Descriptors of every query user's curve against every other's."""
    return _crossed(spark, d, curves.css_block, ("css", "mirror"))


_SETS = "s as (select user_id as name, extract(hour from ts)::double as x, value as y from events where value is not null)"


@query(f"""with {_SETS}, m as (select p.name as a, q.name as b, p.rowid as i, q.rowid as j, sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2) as d from (select *, row_number() over () as rowid from s) p join (select *, row_number() over () as rowid from s) q on p.name <> q.name),
i as (select a, b, max(d) as far, avg(d) as mean from (select a, b, i, min(d) as d from m group by 1, 2, 3) group by 1, 2), j as (select a, b, max(d) as far, avg(d) as mean from (select a, b, j, min(d) as d from m group by 1, 2, 3) group by 1, 2)
select a, b, round(greatest(i.far, j.far), 6) as hausdorff, round(i.mean + j.mean, 6) as chamfer from i join j using (a, b)""")
def curve_set_distances(spark, d):
    rows = _t(spark, d, "events").where("value is not null").select(F.col("user_id").alias("name"), F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"))
    return curves.set_distances(rows).withColumns({c: _rounded_quickly(c, 6) for c in ("hausdorff", "chamfer")})
