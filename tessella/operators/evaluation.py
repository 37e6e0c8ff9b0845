"""Ground-truth metrics over tables of pairs, ranks and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BUCKETS
from .ranking import canonical, near_pairs


def pair_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(precision, recall, f1) of distinct unordered pairs; 1 and 1 if both are empty."""
    p = canonical(found).select("a", "b").distinct().withColumn("p", F.lit(1))
    t = canonical(truth).select("a", "b").distinct().withColumn("t", F.lit(1))
    n = p.join(t, ["a", "b"], "full").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hit"))
    empty = (F.col("np") == 0) & (F.col("nt") == 0)
    rate = lambda c: F.when(empty, 1.0).otherwise(F.col("hit") / F.greatest(F.lit(1), c))
    both = n.select(rate("np").alias("precision"), rate("nt").alias("recall"))
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def f_beta(found: DataFrame, truth: DataFrame, beta: float = 1.0) -> DataFrame:
    """(precision, recall, fbeta) of distinct unordered pairs; a zero denominator gives 0."""
    p = canonical(found).select("a", "b").distinct().withColumn("p", F.lit(1))
    t = canonical(truth).select("a", "b").distinct().withColumn("t", F.lit(1))
    n = p.join(t, ["a", "b"], "full").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.coalesce(F.sum(F.col("p") * F.col("t")), F.lit(0)).alias("hit"))
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    both = n.select(rate(F.col("hit"), F.col("np")).alias("precision"), rate(F.col("hit"), F.col("nt")).alias("recall"))
    b2 = beta * beta
    return both.withColumn("fbeta", rate((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")))


def inversions(order: DataFrame) -> DataFrame:
    """(n, inversions) of order(pos, rank), two numberings from 0 of the same n things: pairs in different order.

    Ranks are read bit by bit: two things of different order part at one bit, where the earlier one has 1 and the later one 0. So a
    running count of ones per bit and common prefix counts all pairs, in buckets of positions, instead of forming them.
    """
    size = order.agg(F.count("*").alias("n"))
    bits = order.crossJoin(F.broadcast(size)).withColumn("level", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")))))
    bits = bits.select("pos", "level", F.expr("shiftright(rank, level + 1)").alias("prefix"), F.expr("shiftright(rank, level) & 1").alias("one"), F.floor(F.col("pos") * BUCKETS / F.col("n")).alias("bucket"))
    group = ["level", "prefix", "bucket"]
    earlier = Window.partitionBy("level", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bits.groupBy(*group).agg(F.sum("one").alias("ones")).select(*group, F.coalesce(F.sum("ones").over(earlier), F.lit(0)).alias("before"))
    up = Window.partitionBy(*group).orderBy("pos")
    found = bits.join(before, group).withColumn("ahead", F.when(F.col("one") == 0, F.col("before") + F.sum("one").over(up)).otherwise(0))
    return found.agg(F.coalesce(F.sum("ahead"), F.lit(0)).cast("long").alias("inversions")).crossJoin(F.broadcast(size)).select("n", "inversions")


def kendall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, distance, score) of two orders (pos from 0, id): inversions, and (tau + 1) / 2; 1 for at most one thing, 0.5 if the ids differ."""
    sizes = predicted.agg(F.count("*").alias("n"))
    met = predicted.join(truth.select("id", F.col("pos").alias("rank")), "id")
    both = inversions(met.select("pos", "rank")).crossJoin(F.broadcast(sizes.withColumnRenamed("n", "all")))
    tau = 1 - 2 * F.col("inversions") / (F.col("n") * (F.col("n") - 1) / 2)
    score = F.when(F.col("all") <= 1, 1.0).when(F.col("n") < F.col("all"), 0.5).otherwise((tau + 1) / 2)
    return both.select("n", F.col("inversions").alias("distance"), score.alias("score"))


def reconstruction(predicted: DataFrame, truth: DataFrame, tolerance: float = 30.0, degrees: float = 10.0) -> DataFrame:
    """One row of metrics of places (id, x, y, angle) against the true ones, both seen from their common first fragment.

    A fragment is right nearer than the tolerance and with an angle off by less than `degrees`; true neighbours (nearer than three
    tolerances) are kept if the found places lie nearer than four. Without neighbours that share is 1; without common fragments all are 0.
    """
    both = predicted.select("id", *[F.col(c).alias("p" + c) for c in ("x", "y", "angle")]).join(truth.select("id", *[F.col(c).alias("t" + c) for c in ("x", "y", "angle")]), "id")
    first = both.agg(F.min(F.struct("id", *[c for c in both.columns if c != "id"])).alias("f"))
    rows = both.crossJoin(F.broadcast(first))

    def seen(k: str) -> dict:
        dx, dy, turn = F.col(k + "x") - F.col(f"f.{k}x"), F.col(k + "y") - F.col(f"f.{k}y"), F.col(f"f.{k}angle")
        return {f"{k}u": F.cos(turn) * dx + F.sin(turn) * dy, f"{k}v": F.cos(turn) * dy - F.sin(turn) * dx, f"{k}a": F.col(k + "angle") - turn}

    rows = rows.withColumns(seen("p") | seen("t"))
    off = F.pmod(F.abs(F.degrees(F.col("pa") - F.col("ta"))), F.lit(360.0))
    rows = rows.select("id", "pu", "pv", "tu", "tv", F.sqrt((F.col("pu") - F.col("tu")) ** 2 + (F.col("pv") - F.col("tv")) ** 2).alias("e"), F.least(off, 360 - off).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = rows.agg(
        F.count("*").alias("n_fragments"), zero(F.avg(((F.col("e") < tolerance) & (F.col("t") < degrees)).cast("int"))).alias("direct"), zero(F.avg((F.col("e") < tolerance).cast("int"))).alias("edge_match_rate"),
        zero(F.sqrt(F.avg(F.col("e") ** 2))).alias("rmse"), zero(F.avg("t")).alias("mean_turn"),
    )
    at = rows.select("id", F.col("tu").alias("x"), F.col("tv").alias("y"), F.col("pu").alias("u"), F.col("pv").alias("v"))
    near = near_pairs(at, 3 * tolerance, strict=True, carry="uv")  # counted where they meet: pairs are neither sent nor kept
    du, dv = F.col("u1") - F.col("u2"), F.col("v1") - F.col("v2")
    kept = near.select((F.sqrt(du * du + dv * dv) < 4 * tolerance).cast("int").alias("k"))
    pairs = kept.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_kept"))
    out = sums.crossJoin(F.broadcast(pairs))
    share = F.when(F.col("n_fragments") == 0, 0.0).when(F.col("n_pairs") == 0, 1.0).otherwise(F.col("n_kept") / F.col("n_pairs"))
    return out.withColumn("neighbors", share)


def missing(expected: DataFrame, placed: DataFrame) -> DataFrame:
    """(id): what is expected and not placed."""
    return expected.select("id").distinct().join(placed.select("id"), "id", "left_anti")


def changed_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, old, new, change) of two settings (key, value): added, removed or changed."""
    both = old.select("key", F.col("value").alias("old"), F.lit(1).alias("o")).join(new.select("key", F.col("value").alias("new"), F.lit(1).alias("n")), "key", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select("key", "old", "new", "change")


def purity(clusters: DataFrame) -> DataFrame:
    """(purity) of (cluster, label): share of rows that carry their cluster's majority label."""
    n = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return n.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def rand_index(clusters: DataFrame) -> DataFrame:
    """(rand) by counting cells, not pairs."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cell = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    both = cell.agg(two("n").alias("both"), F.sum("n").alias("n"))
    rows = cell.groupBy("cluster").agg(F.sum("n").alias("n")).agg(two("n").alias("rows"))
    cols = cell.groupBy("label").agg(F.sum("n").alias("n")).agg(two("n").alias("cols"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return both.crossJoin(rows).crossJoin(cols).select(((pairs - F.col("rows") - F.col("cols") + 2 * F.col("both")) / F.greatest(F.lit(1.0), pairs)).alias("rand"))


def hamming(a: DataFrame, b: DataFrame) -> DataFrame:
    """(share): positions (pos, item) at which two sequences differ."""
    return a.join(b.withColumnRenamed("item", "other"), "pos").agg(F.avg(F.when(F.col("item") == F.col("other"), 0.0).otherwise(1.0)).alias("share"))


def completeness(expected: DataFrame, placed: DataFrame) -> DataFrame:
    """(n_expected, n_placed, share) over distinct ids; 1 if nothing is expected."""
    rows = expected.select("id").distinct().join(placed.select("id").distinct().withColumn("p", F.lit(1)), "id", "left")
    n = rows.agg(F.count("*").alias("n_expected"), F.count("p").alias("n_placed"))
    return n.withColumn("share", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_placed") / F.col("n_expected")))
