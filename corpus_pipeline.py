"""Training-data pipeline over ``documents``: quality rules, line dedup, near dedup,
source mixing, SentencePiece encoding.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes every stage's result
as Parquet in the shared checkpoint folder and the next one reads it. All stages but
the last return the columns of ``documents``; further columns are carried, whatever
their names.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from epiframe.llm.common import materialise, scratch_scope, table  # noqa: E402
from epiframe.llm.lines import cut_lines, row_key  # noqa: E402
from epiframe.llm.mixing import mix_documents, n_tokens  # noqa: E402
from epiframe.llm.neardup import near_duplicates  # noqa: E402
from epiframe.llm.pieces import encode_pieces  # noqa: E402
from epiframe.llm.quality import base_failed, learn_decision_list, with_features, with_statistics  # noqa: E402

MIX_FRACTION = (4, 5)  # share of the remaining tokens that is kept


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go (operator 7)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_lid"), F.col("quality").alias("_q")) \
        .where("_q is not null")
    # the statistics are written once, without the rows: learning and judging both read
    # them. A verdict depends on the text alone, so it meets its rows by (id, text digest),
    # also where ids are shared or lacking.
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    stats = with_features(materialise(with_statistics(keyed, carry=("d", "t")), "pipeline-statistics"))
    labelled = stats.join(labels, stats["doc_id"] == F.col("_lid")).where(~base_failed())
    rules = learn_decision_list(labelled, F.col("_q") == 0)
    kept = stats.where(~base_failed() & rules.keep()).select("d", "t")
    rows = docs.select(*row_key("doc_id", "text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(kept, ["d", "t"], "left_semi").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and lines one edit from an earlier one go; a document that loses
    every line goes too (operator 6). ``n_chars`` follows the text."""
    out = cut_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the least id
    (operator 5)."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token budget is split over domains, languages and sources; each leaf keeps its
    seeded token prefix (operator 9)."""
    slim = docs.select("doc_id", "lang", "source", n_tokens().alias("_n"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return mix_documents(slim, F.col("_n"), MIX_FRACTION).select("_row.*")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document left (operator 3)."""
    return encode_pieces(docs.select("doc_id", "text")).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("piece encoding", pieces_stage),
]

# Learned rules, sampled signatures and the piece lattice have no SQL form; the
# stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage wrote on the way goes once its result is written,
    and so does the result before it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope() as on_the_way:
            result = stage(spark, docs, sf_dir)
            with scratch_scope() as own:
                docs = materialise(result, "pipeline-" + name.replace(" ", "-"))
        on_the_way.drop(spark)
        if before is not None:
            before.drop(spark)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
