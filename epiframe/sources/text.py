"""Line-oriented readers: vocabularies, typing CSV, labelled lines, file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.functions.encode import strip_blanks
from epiframe.plans.joins import sized_broadcast


def scan_lines(spark: SparkSession, path: str, min_partitions: int | None = None,
               recursive: bool = True) -> DataFrame:
    """Raw lines (``value``). Files are split by ``spark.sql.files.maxPartitionBytes``;
    a repartition happens only when more partitions are asked for."""
    reader = spark.read
    if recursive:
        # Also switches off partition-directory inference: paths are parsed by
        # with_path_columns instead.
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.text(path)
    if min_partitions and df.rdd.getNumPartitions() < min_partitions:
        df = df.repartition(min_partitions)
    return df


def clean_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Strip each line (spaces, tabs, CR) and drop blank lines."""
    return df.withColumn(col, strip_blanks(col)).filter(F.col(col) != "")


def parse_fields(df: DataFrame, fields: int = 2, col: str = "value",
                 strict: bool = True, keep_line: bool = False) -> DataFrame:
    """Tab-split typed fields.

    ``fields=2``: seq, label (INT). ``fields=3``: seq, abundance (DOUBLE), label.
    Extra fields are ignored. In ``strict`` mode a bad number fails the job (as
    ``int()``/``float()`` raise; surrounding blanks are accepted like there);
    otherwise it becomes NULL.
    """
    parts = F.split(F.col(col), "\t")

    def cast(c, t):
        # try_cast, then an explicit failure: the same under any ANSI setting
        v = c.try_cast(t)
        if not strict:
            return v
        return F.when(v.isNull() & c.isNotNull(), F.raise_error(F.concat(
            F.lit(f"not a valid {t} field in line: "), F.col(col)))).otherwise(v)

    out = [parts.getItem(0).alias("seq")]
    if fields == 2:
        label_src = F.get(parts, 1)
    elif fields == 3:
        out.append(cast(F.get(parts, 1), "double").alias("abundance"))
        label_src = F.get(parts, 2)
    else:
        raise ValueError("fields must be 2 or 3")
    if strict:
        label_src = F.when(label_src.isNull(), F.raise_error(
            F.concat(F.lit("missing field in line: "), F.col(col)))).otherwise(label_src)
    out.append(cast(label_src, "int").alias("label"))
    keep = [c for c in df.columns if c != col] + ([col] if keep_line else [])
    return df.select(*keep, *out)


def numbered_lines(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, line_no, value): lines with their 1-based number in their file.

    Without reading a file whole: every file split (``_metadata.file_block_start``)
    numbers its own lines in read order, and the line counts of a file's splits (one
    row per split) give the offsets. A line crossing a split boundary belongs to the
    split it starts in, as the line reader assigns it.
    """
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # increases along the read order inside a task; file splits are fixed by
        # the listing, so a re-run task reads the same rows in the same order
        F.monotonically_increasing_id().alias("_rid"),
        "value")
    local = lines.withColumn(
        "_i", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_rid")))
    sizes = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "_block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_off"))
    return local.join(sized_broadcast(offsets), ["file", "_block"]).select(
        "file", (F.col("_off") + F.col("_i")).alias("line_no"), "value")


def read_labelled(spark: SparkSession, path: str, fields: int = 2, strict: bool = True,
                  with_paths: bool = True, line_no: bool = False) -> DataFrame:
    """Labelled lines -> (seq, [abundance,] label [, split, sample, label_from_path]).

    ``line_no`` adds (file, line_no), a unique key of every line: sampling, batching
    and dropout need one, and it restores file order. Blank lines use up a number.
    """
    lines = numbered_lines(spark, path) if line_no else scan_lines(spark, path)
    if with_paths:
        lines = join_path_columns(lines, file_paths(spark, path), "file" if line_no else None)
    return parse_fields(clean_lines(lines), fields, strict=strict)


# Path patterns: "<root>/<split>/<sample>_<pos|neg>.<ext>" as the reference lays
# files out, or the same names as partition directories ("split=train",
# "file=<sample>_pos.txt") as Spark writers produce them.
# The last split directory and the last component count (a Spark part file stands for
# its directory), whatever the root is called.
_SPLIT_RE = r"^(?:.*/)?(?:[A-Za-z_]+=)?(train|test)(?:/|$)"
_NAME_RE = r"([^/]*)/?$"
_CLASS_RE = r"^(.+)_(pos|neg)(?:\..*)?$"


def path_columns(path: Column) -> dict[str, Column]:
    # file paths of a scan are URIs: undo percent signs, leave plus signs alone
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    whole = F.regexp_replace(plain, "/part-[^/]*$", "")
    name = F.regexp_replace(F.regexp_extract(whole, _NAME_RE, 1), "^[A-Za-z_]+=", "")
    cls = F.regexp_extract(name, _CLASS_RE, 2)
    split = F.regexp_extract(plain, _SPLIT_RE, 1)
    return {
        "split": F.when(split != "", split),
        "sample": F.when(cls != "", F.regexp_extract(name, _CLASS_RE, 1))
        .otherwise(F.regexp_extract(name, r"^([^.]*)", 1)),
        "path_label": F.when(cls == "pos", F.lit(1)).when(cls == "neg", F.lit(0)),
    }


def with_path_columns(df: DataFrame, path_col: str | None = None) -> DataFrame:
    """Add ``split``, ``sample`` and ``path_label`` parsed from each row's file path
    (the hidden ``_metadata.file_path`` of a file source by default)."""
    path = F.col(path_col) if path_col else F.col("_metadata.file_path")
    return df.select("*", *[c.alias(n) for n, c in path_columns(path).items()])


def file_paths(spark: SparkSession, path: str) -> DataFrame:
    """(file) of every non-empty file under ``path``: a metadata scan, no file is opened."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.col("_metadata.file_path").alias("file")))


def join_path_columns(df: DataFrame, files: DataFrame, path_col: str | None = None) -> DataFrame:
    """:func:`with_path_columns` with the parsing done once a file: the parsed paths are
    joined to the lines, broadcast when measured small."""
    parsed = files.select(F.col("file").alias("_path"), *[c.alias(n) for n, c in path_columns(F.col("file")).items()])
    at = F.col(path_col) if path_col else F.col("_metadata.file_path")
    named = df.select("*", at.alias("_at"))
    return named.join(sized_broadcast(parsed), F.col("_at") == F.col("_path"), "left").drop("_at", "_path")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Headerless term list -> (term, code), code = 1-based line number.

    Each line is stripped; a blank line still uses up its number (and is not
    returned); a repeated term keeps its last number. Several files are
    numbered one after another in path order.

    Lines are numbered per file (:func:`numbered_lines`); the files' line counts (one
    row per file) give the offsets between files. Line ends are \\n, \\r\\n or a lone
    \\r, as in Python.
    """
    lines = numbered_lines(spark, path, recursive=False)
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    # one row per file of one vocabulary
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))
    numbered = lines.join(sized_broadcast(offsets), "file").select(
        strip_blanks("value").alias("term"), (F.col("off") + F.col("line_no")).alias("code"))
    return (numbered.filter(F.col("term") != "")
            .groupBy("term").agg(F.max("code").cast("int").alias("code")))


def read_slots(spark: SparkSession, path: str, id_col: str = "sample_id") -> DataFrame:
    """Headered typing CSV: first column the sample id, the others allele slots.

    Every column is read as STRING (no inference); the first is renamed ``id_col``.
    """
    df = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, id_col) if first != id_col else df
