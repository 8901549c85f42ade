"""Dataset layout: expected files, completeness check, split/class readers."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.plans.joins import sized_broadcast

CLASSES = ("pos", "neg")


def dataset_manifest(samples: DataFrame, id_col: str = "sample_id", split_col: str = "split",
                     classes: Sequence[str] = CLASSES) -> DataFrame:
    """Expected files: every (split, sample) once per class, named
    ``<sample>_<class>``. Classes are a literal array exploded per row, so no
    join is needed."""
    cls = F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
    out = samples.select(split_col, id_col, cls)
    return out.withColumn("file", F.concat_ws("_", F.col(id_col).cast("string"), F.col("cls")))


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of every file under ``root``, empty files included.

    No file is opened: sizes come from a distributed metadata scan (the content column of
    Spark's binary reader is not selected). That scan plans no task for an empty file, so
    names come from the reader's file index, which Spark lists in parallel and holds on
    the driver for any read; the listing is bounded by the number of files, not by their
    size."""
    read = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(root))
    names = [(unquote(p),) for p in read.inputFiles()]
    sizes = read.select("path", F.col("length").alias("_n"), F.col("modificationTime").alias("modified"))
    listed = spark.createDataFrame(names, "path string").hint("rebalance")
    # one leading slash or several after the scheme name the same file
    def plain(c: str) -> Column:
        return F.regexp_replace(F.col(c), "^([a-z0-9]+:)/+", "$1/")
    return listed.withColumn("_p", plain("path")).join(sizes.select(plain("path").alias("_p"), "_n", "modified"), "_p", "left") \
        .select("path", F.coalesce("_n", F.lit(0)).cast("long").alias("bytes"), "modified")


def listed_files(listing: DataFrame, extension: str = "txt") -> DataFrame:
    """(split, file, cls, parts, bytes) of the dataset's files in a listing: one row a
    ``<sample>_<class>`` file or directory of part files, named in the path as
    ``split=<split>/file=<file>.<ext>`` or ``<split>/<file>.<ext>``. Hidden and marker
    files are left out."""
    name = rf"(?:^|/)(?:split=)?([^/=]+)/(?:file=)?([^/=]+)\.{extension}(?:/[^/]*)?$"
    path = F.col("path")
    found = listing.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]")).select(
        F.regexp_extract(path, name, 1).alias("split"),
        F.regexp_extract(path, name, 2).alias("file"), "bytes").where("file <> ''")
    return found.groupBy("split", "file").agg(F.count(F.lit(1)).alias("parts"), F.sum("bytes").alias("bytes")) \
        .withColumn("cls", F.regexp_extract("file", "_([^_]+)$", 1))


def reconcile(manifest: DataFrame, found: DataFrame, keys: Sequence[str] = ("split", "file"),
              cls: str = "cls") -> DataFrame:
    """Every expected or found file with ``status`` ``present``, ``missing`` (expected, not
    found), ``surplus`` (found, not expected) or ``empty`` (found and expected, 0 bytes).

    One full outer join on the keys, of which NULL is a value like any other; a file
    listed twice counts once. ``found`` may lack ``cls`` (taken from the file name's
    last part) and ``bytes`` (no file is then empty)."""
    keys = list(keys)
    kind = F.first(cls).alias("_fc") if cls in found.columns else F.lit(None).cast("string").alias("_fc")
    size = F.sum("bytes").alias("_fb") if "bytes" in found.columns else F.lit(1).cast("bigint").alias("_fb")
    have = found.groupBy(*[F.col(k).alias(f"_f_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_fn"), kind, size)
    want = manifest.groupBy(*keys).agg(F.first(cls).alias("_mc"), F.lit(True).alias("_m"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    both = want.join(have, same, "full_outer")
    expected, present = F.coalesce("_m", F.lit(False)), F.col("_fn").isNotNull()
    return both.select(
        *[F.when(expected, F.col(k)).otherwise(F.col(f"_f_{k}")).alias(k) for k in keys],
        F.coalesce("_mc", "_fc", F.regexp_extract(F.col(f"_f_{keys[-1]}"), "_([^_]+)$", 1)).alias(cls),
        F.when(~present, "missing").when(~expected, "surplus").when(F.col("_fb") == 0, "empty")
        .otherwise("present").alias("status"))


def check_complete(manifest: DataFrame, present: DataFrame,
                   keys: Sequence[str] = ("split", "file")) -> DataFrame:
    """Per (split, class): expected, present, missing, surplus and empty file counts, and
    ``exact``: every expected file is there with content, and no other one is.

    ``present`` lists the files found. A class with surplus files only has a row too."""
    files = reconcile(manifest, present, keys)

    def n(*status: str) -> Column:
        return F.count(F.when(F.col("status").isin(*status), 1))
    return files.groupBy(keys[0], "cls").agg(
        n("present", "missing", "empty").alias("expected"), n("present", "empty").alias("present"),
        n("missing").alias("missing"), n("surplus").alias("surplus"), n("empty").alias("empty"),
        (n("present") == F.count(F.lit(1))).alias("exact"))


def missing_files(manifest: DataFrame, present: DataFrame,
                  keys: Sequence[str] = ("split", "file")) -> DataFrame:
    return reconcile(manifest, present, keys).where("status = 'missing'").select(*keys, "cls")


def surplus_files(manifest: DataFrame, present: DataFrame,
                  keys: Sequence[str] = ("split", "file")) -> DataFrame:
    return reconcile(manifest, present, keys).where("status = 'surplus'").select(*keys, "cls")


def assert_complete(report: DataFrame) -> None:
    """Fail like the reference's assertions unless every class of every split holds
    exactly its expected files (one row per split and class reaches the driver)."""
    bad = [r for r in report.collect() if not r["exact"]]
    if bad:
        raise AssertionError(f"dataset is not as expected: {bad}")


def present_partitions(spark: SparkSession, root: str,
                       cols: Sequence[str] = ("split", "sample_id", "label")) -> DataFrame:
    """The (split, sample, class) directories that hold rows under ``root``.

    Only partition columns are selected, so the scan reads no data columns; the
    result has one row per directory.
    """
    return spark.read.parquet(root).select(*cols).distinct()


def check_examples(spark: SparkSession, root: str, manifest: DataFrame,
                   id_col: str = "sample_id") -> DataFrame:
    """``check_complete`` for the Parquet example layout: the manifest's
    (split, sample, cls) against the directories present."""
    present = present_partitions(spark, root).select(
        "split", F.concat_ws("_", F.col(id_col).cast("string"),
                             F.when(F.col("label") == 1, "pos").otherwise("neg")).alias("file"))
    return check_complete(manifest, present)


def read_examples(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def read_class_sets(spark: SparkSession, root: str, split: str = "train",
                    label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(positives, negatives) of a split; both are directory-pruned scans."""
    df = read_examples(spark, root).filter(F.col("split") == split)
    return df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)


def read_sample(spark: SparkSession, root: str, sample_ids: DataFrame | Sequence,
                split: str = "test") -> DataFrame:
    """Both classes of held-out samples. ``sample_ids`` is a list (pruned by
    directory) or a DataFrame of ids (semi join, broadcast when small)."""
    df = read_examples(spark, root).filter(F.col("split") == split)
    if isinstance(sample_ids, DataFrame):
        return df.join(sized_broadcast(sample_ids.select("sample_id")), "sample_id", "left_semi")
    return df.filter(F.col("sample_id").isin(list(sample_ids)))
