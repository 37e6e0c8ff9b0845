"""Exact deduplication through content-defined chunk recipes, with DataFrame functions only.

A text without its white space is cut into chunks where its own content says so, hence equal texts give equal
cuts wherever they stand. Each chunk gets a 64-bit identifier; the chunk store keeps every distinct chunk once, which
both verifies the identifiers (one content each) and is the only place that long contents move to: partial aggregation
folds repeated chunks before the shuffle. Documents are then compared as ordered lists of identifiers.
If two contents should share an identifier, the store numbers its contents, and the recipes that hold it carry the number.

Defined results: null texts count as empty; an empty text has an empty recipe, so all of them are equal; a null doc_id
ranks after all others. Of equal texts exactly one row stays: rows with the same length and doc_id are told apart by
their original text (a hash of it), and of rows equal in both any one stays. Very long texts are lists of many chunks and are never moved
as a whole for comparison. Extra columns, whatever their names, are ignored by `exact_groups` and kept by `drop_copies`; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, Scratch, is_empty, row_key, staying_rows

#: A cut follows two characters of this class (code points that are 3 modulo 16 in ASCII and Latin-1).
CUT_CLASS = "[#3CScs£³ÃÓãó]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def chunks_of(norm: Column, least: int = 256, most: int = 1024) -> Column:
    """Content-defined chunks: the shortest run of least..most characters that ends at a cut, else of most."""
    pattern = f"(?s).{{{least},{most}}}?(?<={CUT_CLASS}{{2}})|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _id(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND((1 << bits) - 1)


def chunk_store(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(chunk_id, chunk): every distinct chunk of the texts once."""
    found = docs.select(F.explode(chunks_of(normalised(F.col("text")))).alias("chunk"))
    return found.select(_id(F.col("chunk"), id_bits).alias("chunk_id"), "chunk").distinct()


def variants(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(chunk_id, chunk, variant) of the identifiers that stand for more than one content; none, as a rule."""
    store = chunk_store(docs, id_bits)
    twofold = store.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    numbered = Window.partitionBy("chunk_id").orderBy("chunk")
    return store.join(twofold, "chunk_id").withColumn("variant", F.row_number().over(numbered) - 1)


def recipes(docs: DataFrame, scratch: Scratch, id_bits: int = 64) -> DataFrame:
    """(node, row_key, doc_id, n_points, text_sha256, recipe) with verified identifiers, one written row per input row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    norm = F.col("norm")  # a column of its own, so that it is made once
    plain = base.withColumn("norm", normalised(F.col("text"))).select(
        F.monotonically_increasing_id().alias("node"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n_points"),
        F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        F.concat_ws(",", F.transform(chunks_of(norm), lambda c: _id(c, id_bits).cast("string"))).alias("recipe"),
    )
    plain = scratch.keep(plain)
    differing = variants(base, id_bits)
    if is_empty(differing.select("chunk_id")):
        return plain
    parts = (
        base.withColumn("norm", normalised(F.col("text")))
        .select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.posexplode(chunks_of(norm)).alias("pos", "chunk"))
        .withColumn("chunk_id", _id(F.col("chunk"), id_bits))
        .join(differing, ["chunk_id", "chunk"], "left")
    )
    whole = F.struct("pos", F.concat_ws("/", F.col("chunk_id").cast("string"), F.col("variant").cast("string")).alias("id"))
    listed = parts.groupBy("row_key").agg(F.concat_ws(",", F.sort_array(F.collect_set(whole)).getField("id")).alias("recipe"))
    return scratch.keep(plain.drop("recipe").join(listed, "row_key", "left").withColumn("recipe", F.coalesce("recipe", F.lit(""))))


def verdicts(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(node, row_key, doc_id, keep_id, group_size, kept, text_sha256): the row with most code points, then the smallest doc_id, stays."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = recipes(docs, scratch, id_bits)
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row_key", "node")
    # Written, so that the join below deals out both sides and a recipe with many rows is split.
    groups = scratch.keep(rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size")))
    return rows.join(groups, "recipe").select(
        "node", "row_key", "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("node") == F.col("best.node")).alias("kept"), "text_sha256"
    )


def exact_groups(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    return verdicts(docs, id_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all their columns."""
    return staying_rows(docs, verdicts(docs.select("doc_id", "text")))


OP8_SQL = f"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_points,
         regexp_replace(coalesce(text, ''), '[{WS}]+', '', 'g') as norm
  from documents
), g as (
  select norm, count(*) as group_size,
         first(doc_id order by n_points desc, doc_id nulls last) as keep_id
  from n group by norm
)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g on n.norm = g.norm
"""
