"""Hierarchical budgeting: weights over a domain-language-source tree become token budgets and seeded selections.

The corpus's tokens per leaf are counted over all documents. From the root down each node's budget is shared among its
children by weight; a child that can't use its share (tokens times `epochs`) frees the rest for its siblings, and only what
no sibling can use goes back up, to the parent's siblings. The tree is planned level by level with window sums over siblings
in the order of capacity by weight, so its leaves stay distributed too. A leaf repeats whole epochs while its budget covers them; the rest
selects the token-prefix of one more epoch: documents in the order of md5(seed:epoch:doc_id), while their running
token count fits. The prefix is found as a cut-off key per leaf, by totals of 4096 key ranges and an
ordered sum inside the one range where the budget ends, so no leaf's documents ever meet in one task, and applied as a filter.

Defined results: tokens are words between white space; null or empty texts have none and are selected with their order;
a null language or source is the name ""; leaves without tokens repeat once; rows that repeat a doc_id share a key and
are selected together, as are rows whose keys tie; weights that are missing are 1, and a weight of 0 selects nothing; very long
texts count whole; extra columns, whatever their names, are ignored by `select` and kept by `mixed`; an empty table selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, Scratch

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """weights: by path, ("domain1", "en"); "*" stands for any name. share: budget as a share of all tokens."""

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    share: float = 0.6
    epochs: int = 2
    seed: str = "mix"

    def weight(self, path: Sequence[str]) -> float:
        for key in (tuple(path), ("*",) * (len(path) - 1) + (path[-1],)):
            if key in self.weights:
                return float(self.weights[key])
        return 1.0


def domain_of(source: Column, domains: int = 4) -> Column:
    """The table names no domain; a source's number deals it into one of `domains`."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(domains)).cast("string")))


def share_out(budget: float, needs: Sequence[tuple[float, float]]) -> list[float]:
    """Parts of the budget by weight, none above its capacity; what is freed goes to the other siblings by weight."""
    parts, left = [0.0] * len(needs), float(budget)
    open_ = sorted((i for i, (w, c) in enumerate(needs) if w > 0 and c > 0), key=lambda i: needs[i][1] / needs[i][0])
    weight = sum(needs[i][0] for i in open_)
    for i in open_:
        w, c = needs[i]
        parts[i] = min(c, left * w / weight)
        left, weight = left - parts[i], weight - w
    return parts


def _weight(mix: Mix, depth: int) -> Column:
    """The weight of a node at `depth` levels; the weights are a parameter, so their list is small."""
    own = F.lit(1.0)
    for path, w in sorted(mix.weights.items(), key=lambda x: "*" not in x[0]):
        if len(path) == depth:
            same = F.lit(True)
            for level, name in zip(LEVELS, path, strict=False):
                same = same & (F.col(level) == name) if name != "*" else same
            own = F.when(same, float(w)).otherwise(own)
    return own


def plan_leaves(tokens: Mapping[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], int]:
    """Token budget of every leaf path, for a tree in memory: the plan that `plan` makes of tables."""
    found: dict[tuple[str, ...], int] = {}

    def able(path: tuple[str, ...]) -> float:
        return float(tokens[path] * mix.epochs) if all(mix.weight(path[:k]) > 0 for k in (1, 2, 3)) else 0.0

    def spread(prefix: tuple[str, ...], budget: float) -> None:
        if len(prefix) == len(LEVELS):
            found[prefix] = int(budget + 1e-6)
            return
        below = sorted({p[: len(prefix) + 1] for p in tokens if p[: len(prefix)] == prefix})
        needs = [(mix.weight(k), sum(able(p) for p in tokens if p[: len(k)] == k)) for k in below]
        for k, part in zip(below, share_out(budget, needs), strict=True):
            spread(k, part)

    spread((), mix.share * sum(tokens.values()))
    return found


def plan(tokens: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """tokens(domain, lang, source, t) with the budget of every leaf: (domain, lang, source, t, weight, budget)."""
    leaves = tokens
    for depth in range(1, len(LEVELS) + 1):
        leaves = leaves.withColumn(f"w{depth}", _weight(mix, depth))
    able = F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("t").cast("double") * mix.epochs).otherwise(0.0)
    leaves = scratch.keep(leaves.withColumn("c", able))
    budgets = None
    for depth in range(1, len(LEVELS) + 1):
        own, above = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*own).agg(F.first(f"w{depth}").alias("w"), F.sum("c").alias("c"))
        if budgets is None:
            nodes = nodes.withColumn("budget", F.lit(mix.share * (leaves.agg(F.sum("t")).first()[0] or 0)))
        else:
            nodes = nodes.join(budgets, above)
        budgets = scratch.keep(_shared_out(nodes, above).select(*own, "budget"))
    return leaves.join(budgets, list(LEVELS)).select(*LEVELS, "t", F.col("w3").alias("weight"), F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _shared_out(nodes: DataFrame, above: list[str]) -> DataFrame:
    """nodes(w, c, budget) with the parent's budget replaced by their own part of it, as `share_out` deals it out.

    In the order of c / w the first siblings are filled up; from the first one that the level c / w of what is left doesn't fill,
    all get that level times their weight.
    """
    open_ = (F.col("w") > 0) & (F.col("c") > 0)
    nodes = nodes.withColumn("ratio", F.when(open_, F.col("c") / F.col("w")))
    siblings = Window.partitionBy(*above)
    before = siblings.orderBy("ratio", *LEVELS[: len(above) + 1]).rowsBetween(Window.unboundedPreceding, -1)
    filled, weighed = (F.coalesce(F.sum(F.when(open_, F.col(x))).over(before), F.lit(0.0)) for x in ("c", "w"))
    level = (F.col("budget") - filled) / (F.sum(F.when(open_, F.col("w"))).over(siblings) - weighed)
    nodes = nodes.withColumn("level", F.when(open_, level))
    nodes = nodes.withColumn("final", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(siblings))
    part = F.least(F.col("c"), F.coalesce(F.col("final") * F.col("w"), F.col("c")))
    return nodes.withColumn("budget", F.when(open_, F.greatest(part, F.lit(0.0))).otherwise(0.0))


def _leaves(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        "doc_id", domain_of(F.col("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{WS}]+")).cast("long").alias("n_tokens"),
    )


def _key(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def cut_offs(docs: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, whole, cut): a document is taken `whole` times, once more if its key is at most `cut`."""
    scratch = Scratch(docs.sparkSession, "mixture")
    rows = scratch.keep(_leaves(docs))
    budgets = plan(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t")), mix, scratch)
    hollow = F.col("t") == 0
    whole = F.when(hollow, (F.col("weight") > 0).cast("long")).otherwise(F.expr("budget div greatest(t, 1)"))
    leaves = budgets.withColumn("whole", whole)
    leaves = scratch.keep(leaves.select(*LEVELS, "whole", F.when(hollow, 0).otherwise(F.col("budget") - F.col("whole") * F.col("t")).alias("rest"), hollow.alias("hollow")))
    keyed = rows.join(leaves, list(LEVELS)).withColumn("key", _key(mix.seed, F.col("whole"), F.col("doc_id")))
    ranges = keyed.groupBy(*LEVELS, "rest", F.substring("key", 1, 3).alias("range")).agg(F.sum("n_tokens").alias("t"))
    order = Window.partitionBy(*LEVELS).orderBy("range")
    ends = ranges.withColumn("upto", F.sum("t").over(order)).where(F.col("upto") > F.col("rest"))
    ends = ends.groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("base"))).alias("e"))
    ends = scratch.keep(ends.select(*LEVELS, F.col("e.range").alias("range"), F.col("e.base").alias("base")))
    inside = keyed.join(ends, list(LEVELS)).where(F.substring("key", 1, 3) == F.col("range"))
    # Rows with equal keys are peers: the running sum counts them together.
    inside = inside.withColumn("upto", F.col("base") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key")))
    last = inside.where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cuts = leaves.join(ends, list(LEVELS), "left").join(last, list(LEVELS), "left")
    # A range's name sorts before all its keys; "g" sorts behind every key.
    cut = F.when(F.col("hollow") | ((F.col("rest") == 0) & (F.col("whole") == 0)), "").otherwise(F.coalesce("last", "range", F.lit("g")))
    out = scratch.keep(cuts.select(*LEVELS, "whole", cut.alias("cut")))
    scratch.drop(rows, leaves, ends)
    return out


def select(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, repeats) for every row; repeats is 0 where the mixture leaves it out."""
    cuts = cut_offs(docs, mix)
    found = _leaves(docs).join(cuts, list(LEVELS))
    once_more = (_key(mix.seed, F.col("whole"), F.col("doc_id")) <= F.col("cut")).cast("long")
    return found.select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + once_more).alias("repeats"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture itself: each selected document as often as it repeats, with its own columns."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    at = dict(zip(docs.columns, own, strict=True))
    cuts = cut_offs(docs, mix)
    name = lambda c: F.coalesce(F.col(at[c]).cast("string"), F.lit(""))
    leafed = plain.withColumns({"domain": domain_of(F.col(at["source"])), "lang": name("lang"), "source": name("source")})
    found = leafed.join(cuts, list(LEVELS))
    repeats = F.col("whole") + (_key(mix.seed, F.col("whole"), F.col(at["doc_id"])) <= F.col("cut")).cast("long")
    found = found.withColumn("_n", repeats).where("_n > 0")
    if mix.epochs > 1:
        found = found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return found.select(*own).toDF(*docs.columns)
