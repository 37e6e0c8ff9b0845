"""Graphs as tables of weighted edges (a, b, weight): components, spanning forests, shortest paths, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def build(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges (a, b, weight) with a < b of the cells above the diagonal whose score is above the threshold."""
    return scores.where((F.col("a") < F.col("b")) & (F.col("score") > threshold)).select("a", "b", F.col("score").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, strength)."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of links(a, b): the smallest node of each component.

    Hooking and pointer jumping: of two roots that a link joins the larger one hooks below the smallest such neighbour, then parents are
    replaced by their parents' parents until all are roots, so a long chain folds by halves whatever the order of its ids.
    """
    links = cut(links.where("a <> b").select("a", "b"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    parent = cut(nodes.select("node", F.col("node").alias("p")))
    while True:
        of = lambda name: parent.select(F.col("node").alias(name), F.col("p").alias("p_" + name))
        roots = links.join(of("a"), "a").join(of("b"), "b").where("p_a <> p_b")
        hooks = roots.select(F.greatest("p_a", "p_b").alias("node"), F.least("p_a", "p_b").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        hooks = cut(hooks)
        if not hooks.take(1):
            return parent.select("node", F.col("p").alias("component"))
        parent = cut(parent.join(hooks, "node", "left").select("node", F.coalesce("to", "p").alias("p")))
        while True:
            jumped = parent.join(parent.select(F.col("node").alias("p"), F.col("p").alias("pp")), "p").select("node", "p", "pp")
            if not jumped.where("p <> pp").take(1):
                break
            parent = cut(jumped.select("node", F.col("pp").alias("p")))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The lightest spanning tree of every component: each part joins another one over its lightest edge out, until none has one (Boruvka).

    Equal weights go by the ids, so the forest is the one that this order names. Parts at least halve in number with every round.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b").distinct())
    part = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("c")))
    chosen = edges.limit(0)
    while True:
        of = lambda end: part.select(F.col("node").alias(end), F.col("c").alias("c_" + end))
        out = edges.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b")
        ends = out.select(F.col("c_a").alias("c"), F.col("c_b").alias("to"), "weight", "a", "b").union(out.select("c_b", "c_a", "weight", "a", "b"))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("weight", "a", "b", "to")).alias("e")).select("c", "e.*"))
        if not best.take(1):
            return chosen
        chosen = cut(chosen.unionByName(best.select("a", "b", "weight").distinct()))
        # Two parts that chose the same edge: the smaller one is the root.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        parent = cut(best.join(back, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("p")))
        while True:
            jumped = cut(parent.join(parent.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").select("c", "p", "pp"))
            if not jumped.where("p <> pp").take(1):
                break
            parent = jumped.select("c", F.col("pp").alias("p"))
        part = cut(part.join(parent, "c", "left").select("node", F.coalesce("p", "c").alias("c")))


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, distance, hops, before): least sums of weights from each of sources(id) to all it reaches.

    All paths grow by one edge a round, only from places that the last round made nearer. Equal distances keep the fewer hops, then the
    smaller id before.
    """
    steps = cut(both_ways(edges))
    reached = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("long").alias("before")))
    fresh = reached
    while fresh.take(1):
        grown = fresh.join(steps, fresh["id"] == steps["a"]).select("source", F.col("b").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), (F.col("hops") + 1).alias("hops"), F.col("a").alias("before"))
        best = grown.groupBy("source", "id").agg(F.min(F.struct("distance", "hops", "before")).alias("m")).select("source", "id", "m.*")
        old = reached.select("source", "id", F.col("distance").alias("d0"), F.col("hops").alias("h0"), F.col("before").alias("b0"))
        both = best.join(old, ["source", "id"], "left")
        nearer = F.col("d0").isNull() | (F.col("distance") < F.col("d0")) | ((F.col("distance") == F.col("d0")) & (F.col("hops") < F.col("h0"))) | ((F.col("distance") == F.col("d0")) & (F.col("hops") == F.col("h0")) & (F.col("before") < F.col("b0")))
        fresh = cut(both.where(nearer).select("source", "id", "distance", "hops", "before"))
        reached = cut(reached.join(fresh.select("source", "id"), ["source", "id"], "left_anti").unionByName(fresh))
    return reached
