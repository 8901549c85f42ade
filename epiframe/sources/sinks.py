"""Writers (W1-W4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from epiframe.functions.alphabet import RESIDUE_CODES

MAX_RECORDS_PER_FILE = 5_000_000


def write_lines(df: DataFrame, path: str, col: str = "value",
                partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One text line per row; with ``partition_by`` one directory per value.

    The rows are rebalanced on the partition columns first (AQE splits a hot
    value over several writers and merges tiny ones), so a sample holding a
    third of all rows is still written by many tasks.
    """
    out = df.select(col, *partition_by)
    if partition_by:
        out = out.hint("rebalance", *partition_by)
    (out.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy(*partition_by).text(path))


def write_ordered_lines(df: DataFrame, path: str, order: Sequence[str], col: str = "value",
                        n_files: int | None = None) -> None:
    """Text files whose lines, file after file in path order, follow ``order``.

    The distributed form of one sorted file: rows are cut into ranges of the whole sort
    key, each range is sorted and written by its own task, and part files are named in
    the order of the ranges (up to 100,000 files, the width of Spark's part numbers).
    """
    n = [n_files] if n_files else []
    df.repartitionByRange(*n, *order).sortWithinPartitions(*order).select(col) \
        .write.mode("errorifexists").text(path)


def write_merged(df: DataFrame, path: str, col: str = "value", order: Sequence[str] = ()) -> None:
    """Export helper: one single text file (the reference's part-file merge).

    Everything passes through one writer task, so this is for small outputs
    (reports); :func:`write_ordered_lines` keeps an order over many files.
    """
    out = df.orderBy(*order) if order else df
    out.select(col).coalesce(1).write.mode("errorifexists").text(path)


def write_examples(df: DataFrame, root: str,
                   partition_by: Sequence[str] = ("split", "sample_id", "label"),
                   mode: str = "errorifexists") -> None:
    """Example rows as Parquet partitioned by split, sample and class.

    Readers prune to one split/class/sample by directory (see
    ``epiframe.sources.dataset``).
    """
    (df.hint("rebalance", *partition_by).write.mode(mode)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy(*partition_by).parquet(root))


def residue_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(RESIDUE_CODES.items(), key=lambda kv: kv[1]),
                                 "letter string, code int")


def save_dictionaries(residues: DataFrame, sample_codes: DataFrame, path: str,
                      vocab: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Persist the residue table, the per-sample codes and (optionally) the
    allele vocabulary as small Parquet tables under ``path``."""
    residues.coalesce(1).write.mode(mode).parquet(f"{path}/residues")
    sample_codes.write.mode(mode).parquet(f"{path}/samples")
    if vocab is not None:
        vocab.coalesce(1).write.mode(mode).parquet(f"{path}/vocab")


def load_dictionaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(residues, sample_codes) as saved by :func:`save_dictionaries`."""
    return spark.read.parquet(f"{path}/residues"), spark.read.parquet(f"{path}/samples")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """The allele vocabulary (term, code) as saved by :func:`save_dictionaries`."""
    return spark.read.parquet(f"{path}/vocab")


def residue_codes_from(residues: DataFrame) -> dict[str, int]:
    """The residue table as a dict for :func:`epiframe.functions.encode_letters`
    (one row per letter)."""
    return {r["letter"]: int(r["code"]) for r in residues.collect()}
