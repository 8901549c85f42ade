"""Stand-in relations derived from the driver's tables.

The reference's own inputs (peptide files, allele lists, donor typing) are not
shipped, so the same shapes are derived from the generated tables:

* ``SEQ``   – words of 8..11 residue letters from labelled documents,
  key (doc_id, pos), one donor sample per document, quality as label.
* ``VOC``   – the distinct part brands as the allele vocabulary, coded 1..n.
* ``SLOTS`` – every part is one allele slot: sample ``p_partkey div 6``,
  slot ``p_partkey % 6``, term ``p_brand``.

Each function reads whole tables; the DuckDB twins are in ``epiframe.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stand-in layout.
N_SEQ_SAMPLES = 33          # documents are spread over donor samples 0..32
SLOTS_PER_SAMPLE = 6        # A1, A2, B1, B2, C1, C2
SEQ_PATTERN = "^[ACDEFGHIKLMNPQRSTVWYOUZ]{8,11}$"
SEQ_MIN, SEQ_MAX = 8, 11   # the length range of SEQ_PATTERN, tested first (cheap)
WORD_PATTERN = "[A-Za-z]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ(doc_id, pos, seq, sample_id, label, abundance).

    Words are extracted and filtered before the join, so only short rows (never
    the document text) reach the shuffle.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    words = docs.select(
        "doc_id", "n_chars",
        F.posexplode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0)).alias("pos", "w"))
    words = (words.filter(F.length("w").between(SEQ_MIN, SEQ_MAX))
             .withColumn("seq", F.upper("w"))
             .filter(F.col("seq").rlike(SEQ_PATTERN)))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), "toxic")
    return words.join(labels, "doc_id").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("pos").cast("int").alias("pos"),
        "seq",
        (F.col("doc_id") % N_SEQ_SAMPLES).cast("bigint").alias("sample_id"),
        F.col("label").cast("int").alias("label"),
        (F.col("n_chars") / F.lit(1000.0)).cast("double").alias("abundance"),
        F.col("toxic").cast("int").alias("toxic"),
    )


ALPHABET_CLASS = "[^ACDEFGHIKLMNOPQRSTUVWYZ]"


def _fix_letters(c):
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), ALPHABET_CLASS, "Z")


def seq_flank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ plus ``flank``: the last 5 letters of the previous word and the first
    5 of the next, Z-padded, letters outside the alphabet written as Z."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0).alias("ws"))
    # The word array is a column of its own, so the neighbour look-ups index it
    # instead of re-running the regex per element.
    ws = F.col("ws")
    triples = F.transform(ws, lambda x, i: F.struct(
        F.get(ws, i - 1).alias("prev"), x.alias("w"), F.get(ws, i + 1).alias("nxt")))
    words = docs.select("doc_id", "n_chars", F.posexplode(triples).alias("pos", "t"))
    words = (words.filter(F.length("t.w").between(SEQ_MIN, SEQ_MAX))
             .withColumn("seq", F.upper("t.w")).filter(F.col("seq").rlike(SEQ_PATTERN)))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    flank = F.concat(F.lpad(F.right(_fix_letters(F.col("t.prev")), F.lit(5)), 5, "Z"),
                     F.rpad(F.left(_fix_letters(F.col("t.nxt")), F.lit(5)), 5, "Z"))
    return words.join(labels, "doc_id").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("pos").cast("int").alias("pos"),
        "seq",
        (F.col("doc_id") % N_SEQ_SAMPLES).cast("bigint").alias("sample_id"),
        F.col("label").cast("int").alias("label"),
        (F.col("n_chars") / F.lit(1000.0)).cast("double").alias("abundance"),
        flank.alias("flank"),
    )


def labelled_words(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """(doc_id, pos, seq) for upper-cased words of labelled documents matching ``pattern``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.posexplode(
        F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0)).alias("pos", "w"))
    words = words.withColumn("seq", F.upper("w")).filter(F.col("seq").rlike(pattern))
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return words.join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "seq")


def voc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VOC(term, code): distinct brands numbered 1..n in term order."""
    from epiframe.plans.ordering import dense_codes

    terms = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"))
    return dense_codes(terms, "term")


def slots_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, slot, term) for every part."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.floor(F.col("p_partkey") / SLOTS_PER_SAMPLE).cast("bigint").alias("sample_id"),
        (F.col("p_partkey") % SLOTS_PER_SAMPLE).cast("int").alias("slot"),
        F.col("p_brand").alias("term"))


SLOT_NAMES = ["A1", "A2", "B1", "B2", "C1", "C2"]


def slots_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, A1..C2) like the donor typing file; a missing slot is NULL."""
    lng = slots_long(spark, sf_dir)
    return lng.groupBy("sample_id").agg(*[
        F.max(F.when(F.col("slot") == i, F.col("term"))).alias(n)
        for i, n in enumerate(SLOT_NAMES)])


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCORED(doc_id, pos, sample_id, label, score): an integer score with ties."""
    s = seq_table(spark, sf_dir)
    return s.select("doc_id", "pos", "sample_id", "label",
                    (F.length("seq") + F.instr("seq", "E")).cast("double").alias("score"))
