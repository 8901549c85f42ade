"""Example tables stored in buckets, so that joins and orders by sample need no exchange.

Rows are cut into spans of the whole sort key (sample, then the order within it), and
the table is bucketed by (span, sample): a sample that holds a third of all rows covers
many spans. Each row carries how many rows of its sample earlier spans hold. Beside the
rows lies a table of the (span, sample) pairs, at most samples + spans rows, bucketed
alike. Joins on (span, sample) and windows by (span, sample) then find their rows in
place.

Buckets are known to Spark through its catalogue. ``register_bucketed`` enters a stored
table into another session's catalogue from the entry written beside it; no metastore
is needed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epiframe.plans.joins import sized_broadcast
from epiframe.plans.ordering import range_buckets
from epiframe.session import stored

SPAN, BEFORE = "span", "before"
SPANS_PER_BUCKET = 4  # spans fall into buckets by their hash: several even them out


def _save(df: DataFrame, name: str, path: str, sample: str, n_buckets: int, order: Sequence[str] = ()) -> None:
    """One file a bucket, rows in order, and the catalogue entry beside the rows."""
    by, order = [SPAN, sample], [SPAN, sample, *order]
    df.repartition(n_buckets, *by).write.bucketBy(n_buckets, *by).sortBy(*order) \
        .option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.createDataFrame([(df.schema.json(), n_buckets, by, order)],
                                    "columns string, n_buckets int, by array<string>, sorted_by array<string>") \
        .coalesce(1).write.parquet(f"{path}.entry")


def write_bucketed(df: DataFrame, name: str, path: str, sample: str, order: Sequence[str], n_buckets: int) -> None:
    """Store ``df`` as the tables ``name`` (its rows, ``span`` and ``before``) at ``path``, and
    ``name``_spans (span, ``sample``) at ``path``.spans.

    ``order`` is the order within a sample and should make it unique; NULL keys sort
    first. An input column ``span`` or ``before`` is an error. An empty table gives empty
    tables.
    """
    clash = {SPAN, BEFORE} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken by the bucketed layout")
    cut = range_buckets(df, [sample, *order], SPANS_PER_BUCKET * n_buckets, out=SPAN)
    sizes = cut.groupBy(SPAN, sample).agg(F.count(F.lit(1)).alias("_n"))
    # a window over at most samples + spans rows
    w = Window.partitionBy(sample).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(sizes.select(F.col(SPAN).alias("_span"), F.col(sample).alias("_sample"),
                                F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint").alias(BEFORE)), "spans")
    same = (F.col(SPAN) == F.col("_span")) & F.col(sample).eqNullSafe(F.col("_sample"))
    _save(cut.join(sized_broadcast(spans), same).drop("_span", "_sample"), name, path, sample, n_buckets, order)
    _save(spans.select(F.col("_span").alias(SPAN), F.col("_sample").alias(sample)),
          f"{name}_spans", f"{path}.spans", sample, n_buckets)


def write_bucketed_dimension(spark: SparkSession, dim: DataFrame, name: str, dim_name: str, path: str,
                             sample: str) -> None:
    """Store ``dim`` (one row per sample) as table ``dim_name`` at ``path``, repeated for every
    span that holds the sample, in the buckets of the table ``name``."""
    _save(spark.table(f"{name}_spans").join(dim, sample), dim_name, path, sample, bucket_count(spark, name))


def bucket_count(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"describe table extended {name}").where("col_name = 'Num Buckets'").select("data_type")
    return int(rows.first()[0])


def register_bucketed(spark: SparkSession, name: str, path: str) -> None:
    """Enter the stored table at ``path`` into this session's catalogue as ``name``, with its buckets."""
    entry = spark.read.parquet(f"{path}.entry").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                        for f in StructType.fromJson(json.loads(entry["columns"])).fields)
    by, order = (", ".join(f"`{c}`" for c in entry[k]) for k in ("by", "sorted_by"))
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) "
              f"sorted by ({order}) into {entry['n_buckets']} buckets location '{path}'")


def attach_bucketed(spark: SparkSession, name: str, dim_name: str, sample: str, value: str,
                    strict: bool = True) -> DataFrame:
    """The rows of ``name`` with column ``value`` of ``dim_name`` by sample (J1), joined inside the
    buckets. A sample without a value fails the job in ``strict`` mode, else its rows go."""
    rows, dim = spark.table(name), spark.table(dim_name).select(SPAN, sample, value)
    out = rows.join(dim, [SPAN, sample], "left" if strict else "inner").drop(SPAN, BEFORE)
    if strict:
        lacking = F.raise_error(F.concat(F.lit(f"no {value} for sample: "), F.coalesce(F.col(sample).cast("string"), F.lit("NULL"))))
        out = out.withColumn(value, F.when(F.col(value).isNull(), lacking).otherwise(F.col(value)))
    return out


def number_bucketed(spark: SparkSession, name: str, sample: str, order: Sequence[str], batch_rows: int) -> DataFrame:
    """The rows of ``name`` with ``rn`` (1-based in its sample's order) and ``batch`` (B5), numbered
    inside the buckets. Rows of a NULL sample are numbered like all others."""
    w = Window.partitionBy(SPAN, sample).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spark.table(name).withColumn("rn", F.count(F.lit(1)).over(w) + F.col(BEFORE))
    return out.withColumn("batch", F.expr(f"(rn - 1) div {int(batch_rows)}")).drop(SPAN, BEFORE)
