"""Cross-site boilerplate lines, found by the distinct sites of each line.

Per line (its 128-bit hash) HyperLogLog sketches of the sites merge by aggregation, partly before the shuffle. Lines whose estimate
lies within `margin` of the threshold are counted exactly; the others are decided by the sketch. Lines of at least
`sites` distinct sites are boilerplate and leave every document. Lines travel as hashes, texts only once, to drop the positions.

Defined results: lines end at "\\n" and are compared without outer spaces; lines of fewer than `least_chars` characters stay; null
sites count for no line; null texts have no line and come back empty; rows that repeat a doc_id are cleaned each by its own
text; very long texts travel as line hashes; extra columns, whatever their names, are kept by `without_boilerplate`; an empty table gives an
empty result; a line on exactly `sites` sites is boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Spread:
    """sites: distinct sites from which a line is boilerplate. margin: share of it around which sketches aren't trusted."""

    sites: int = 8
    least_chars: int = 16
    margin: float = 0.25
    log_k: int = 10


def lines_of(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _hashed(docs: DataFrame, spread: Spread) -> DataFrame:
    """(doc_id, th, site, pos, h1, h2) of every line that may be boilerplate; th tells rows of one doc_id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("source").alias("site"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(F.char_length("line") >= spread.least_chars)
    return rows.select("doc_id", "th", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(spread.least_chars), "line").alias("h2"))


def boilerplate(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(h1, h2) of the lines that at least `sites` distinct sites hold."""
    rows = _hashed(docs, spread).where("site is not null")
    scratch = Scratch(docs.sparkSession, "lines")
    sketched = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", spread.log_k).alias("sketch"))
    spread_of = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about"))
    wide = scratch.keep(spread_of.where(F.col("about") >= int(spread.sites * (1 - spread.margin))))
    sure = wide.where(F.col("about") > spread.sites * (1 + spread.margin)).select("h1", "h2")
    near = wide.where(F.col("about") <= spread.sites * (1 + spread.margin)).select("h1", "h2")
    exact = rows.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return scratch.keep(sure.unionByName(exact.where(F.col("n") >= spread.sites).select("h1", "h2")))


def marked(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """The documents with a column `dropped` behind theirs: positions of their boilerplate lines, or null."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own, strict=True))
    hits = _hashed(docs, spread).join(boilerplate(docs, spread), ["h1", "h2"])
    gone = hits.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("dropped"))
    plain = docs.toDF(*own)
    found = plain.join(gone, plain[at["doc_id"]].eqNullSafe(gone["_id"]) & (F.xxhash64(plain[at["text"]]) == gone["_th"]), "left")
    return found.select(*[F.col(k).alias(c) for c, k in at.items()], "dropped")


def cleaned(text: Column, dropped: Column) -> Column:
    left = F.filter(lines_of(text), lambda _, i: ~F.array_contains(dropped, i))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))


def without_boilerplate(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """The documents with cleaned texts and all their other columns."""
    found = marked(docs.select(*docs.columns), spread)
    text = cleaned(F.col("text"), F.col("dropped"))
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, spread: Spread = Spread()) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars_left, cleaned_sha256) for every row."""
    found = marked(docs.select("doc_id", "text", "source"), spread)
    found = found.withColumn("clean", cleaned(F.col("text"), F.col("dropped")))
    return found.select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_removed"),
        F.char_length("clean").cast("long").alias("n_chars_left"), F.sha2(F.col("clean").cast("binary"), 256).alias("cleaned_sha256"),
    )


OP4_SQL = """
with l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null and text <> ''
), wide as (
  select trim(line, ' ') as t from l where length(trim(line, ' ')) >= 16
  group by 1 having count(distinct source) >= 8
), k as (
  select l.*, coalesce(trim(line, ' ') in (select t from wide), false) as gone from l
), c as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as clean
  from k group by doc_id
)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       length(coalesce(clean, ''))::bigint as n_chars_left, sha256(coalesce(clean, '')) as cleaned_sha256
from documents d left join c on c.doc_id = d.doc_id
"""
