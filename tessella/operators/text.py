"""Word n-gram coherence and seam checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

WORD = "[A-Za-zА-Яа-яЁё]{2,}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bigrams(docs: DataFrame) -> DataFrame:
    """(doc_id, w1, w2, n): neighbouring words and how often they stand in the document, counted inside its own row."""
    w = F.col("w")
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.element_at(w, i).alias("w1"), F.element_at(w, i + 1).alias("w2")))
    return docs.select("doc_id", words(F.col("text")).alias("w")).where("size(w) > 1").select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.w1", "p.w2")


def coherence(docs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(doc_id, coherence) by an add-alpha bigram model of the corpus: 1 - ln(perplexity) / ln(V + 1), in [0, 1]; 0 for fewer than two words.

    Words are counted per document before anything is shuffled by them; a pair's frequency meets the documents' counts in a join whose
    sides are both dealt out, so that Spark splits a pair that very many documents hold.
    """
    per = cut(bigrams(docs).groupBy("doc_id", "w1", "w2").agg(F.count("*").alias("n")))
    c2 = per.groupBy("w1", "w2").agg(F.sum("n").alias("c2"))
    c1 = c2.groupBy("w1").agg(F.sum("c2").alias("c1"))
    v = c2.select("w1").union(c2.select("w2")).distinct().agg(F.count("*").alias("v"))
    model = cut(c2.join(c1, "w1").crossJoin(F.broadcast(v)).select("w1", "w2", F.log((F.col("c2") + alpha) / (F.col("c1") + alpha * F.col("v"))).alias("lp"), "v"))
    sums = per.join(model, ["w1", "w2"]).groupBy("doc_id").agg((-F.sum(F.col("n") * F.col("lp")) / F.sum("n")).alias("h"), F.max("v").alias("v"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("h") / F.log(F.col("v") + 1)))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce(score, F.lit(0.0)).alias("coherence"))


# Fixed pattern: one to three letters, Latin or Cyrillic.
BROKEN = "^[a-zа-яёA-ZА-ЯЁ]{1,3}$"


def seam_score(left: Column, right: Column) -> Column:
    """1.0, 0.5 or 0.2 by how many of the words at the seam are whole words of one to three letters; 0.5 if a side is blank."""
    blank = r"^[\s]*$"
    last = F.regexp_extract(left, r"(\S+)\s*$", 1)
    first = F.regexp_extract(right, r"^\s*(\S+)", 1)
    n = F.rlike(last, F.lit(BROKEN)).cast("int") + F.rlike(first, F.lit(BROKEN)).cast("int")
    return F.when(F.rlike(left, F.lit(blank)) | F.rlike(right, F.lit(blank)), 0.5).when(n == 0, 1.0).when(n == 1, 0.5).otherwise(0.2)


def cleaned(text: Column, strip_marks: bool = False, lower: bool = False) -> Column:
    """Text in NFC without control, format, private and unassigned characters (but for line ends and tabs), blanks folded to one.

    Normal forms aren't among Spark's functions; all else is.
    """

    @F.pandas_udf("string")
    def nfc(s):
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    out = F.regexp_replace(nfc(text), r"[\p{C}&&[^\n\t]]", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s]", "") if strip_marks else out
    out = F.lower(out) if lower else out
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(out, r"^\s+|\s+$", "")
