"""Growing vocabularies: versions whose old terms keep their codes.

A vocabulary is a folder of versions, ``version=1``, ``version=2``, and so on. Each
holds only the terms that it adds, so a snapshot is a range of directories, read with
partition pruning, and code that was trained on an earlier snapshot stays valid.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.plans.ordering import dense_codes

VOCABULARY_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("code", T.IntegerType()),
    T.StructField("version", T.IntegerType()),
])


def new_terms(terms: DataFrame, base: DataFrame | None = None, first: int = 1, col: str = "term") -> DataFrame:
    """(term, code) of the distinct terms that ``base`` lacks, numbered from ``first`` in
    string order (UTF-8 bytes).

    NULL and blank terms get no code. Repeated terms meet after partial aggregation, so
    a term that holds most rows is one row in the join and in the numbering, which runs
    over ranges of the terms (:func:`epiframe.plans.ordering.dense_codes`).
    """
    found = terms.select(F.col(col).alias("term")).where(F.trim("term") != "").distinct()
    if base is not None:
        found = found.join(base.select("term"), "term", "left_anti")
    return dense_codes(found, "term").select("term", (F.col("code") + F.lit(first - 1)).cast("int").alias("code"))


def _stored_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY_SCHEMA).parquet(path)


def vocabulary_at(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(term, code) of the snapshot ``version``: the terms of that version and of all before it."""
    return _stored_versions(spark, path).where(F.col("version") <= int(version)).select("term", "code")


def _has_version(spark: SparkSession, path: str, version: int) -> bool:
    """Whether the version's directory is there (one without terms has no rows)."""
    try:
        spark.read.schema(VOCABULARY_SCHEMA).parquet(f"{path}/version={version}")
    except AnalysisException:
        return False
    return True


def add_version(spark: SparkSession, path: str, version: int, terms: DataFrame, col: str = "term") -> DataFrame:
    """Write version ``version`` (from 1, one after another) below ``path`` and return its snapshot.

    The codes follow from the earlier versions and ``terms`` alone, so a writer that was
    lost is simply run again: the version's directory is overwritten with the same
    codes. A version on which a later one builds is refused, as is a gap in the
    versions. A version without new terms is an empty directory with a schema.
    """
    if version < 1:
        raise ValueError(f"versions count from 1, got {version}")
    if _has_version(spark, path, version + 1):
        raise ValueError(f"version {version} is built on by version {version + 1}")
    base, first = None, 1
    if version > 1:
        if not _has_version(spark, path, version - 1):
            raise ValueError(f"version {version} without version {version - 1} in {path}")
        base = vocabulary_at(spark, path, version - 1)
        first = (base.agg(F.max("code")).first()[0] or 0) + 1
    new_terms(terms, base, first, col).write.mode("overwrite").parquet(f"{path}/version={version}")
    return vocabulary_at(spark, path, version)


def changed_codes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(term, old_code, new_code) of the terms of ``old`` that ``new`` lacks or codes otherwise."""
    n = new.select("term", F.col("code").alias("new_code"))
    return old.select("term", F.col("code").alias("old_code")).join(n, "term", "left") \
        .where(~F.col("old_code").eqNullSafe(F.col("new_code")))
