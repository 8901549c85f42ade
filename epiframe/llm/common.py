"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.session import checkpoint_root, scratch_path, ship_package

# White space of the word rule: words are runs of any other character.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Folders that :func:`materialise` wrote in a :func:`scratch_scope`."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession) -> None:
        """Delete them; nothing may read them any more."""
        for path in self.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


_SCOPES: list[Scratch] = []


@contextmanager
def scratch_scope() -> Iterator[Scratch]:
    """Folders written within the block are noted in the innermost open scope."""
    _SCOPES.append(Scratch())
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage in storage every executor can reach, so a lost executor re-reads
    the table and the work before it is not repeated.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order (NULL or blank text: empty array)."""
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(body.isNull() | (body == ""), F.array().cast("array<string>")) \
        .otherwise(F.split(body, SPACE_RUN))


def prepare_python(spark: SparkSession) -> None:
    """Make the package importable in Python workers and register the shared folder."""
    checkpoint_root(spark)
    ship_package(spark)
