"""Global order without a single-task window.

A window with an ORDER BY and no PARTITION BY runs in one task. The two shapes
here split the ordered domain into buckets whose order agrees with the sort
order, total each bucket (one small row per group and bucket), turn those totals
into offsets, and finish with an ordinary window partitioned by (group, bucket).
Only the bucket totals table (groups x buckets rows) is ever ordered as a whole.

Bucket boundaries are literals in the plan (hash bits, or quantiles computed
once), so a re-run of a lost task sees the same boundaries; a boundary choice
only affects load balance, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 1 << 16


def default_buckets(df: DataFrame) -> int:
    """About four buckets per shuffle partition, a power of two (at most
    ``MAX_BUCKETS``; the number only affects load balance, never the result)."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(MAX_BUCKETS, 1 << math.ceil(math.log2(4 * max(shuffle, 1))))


def range_buckets(df: DataFrame, order: Sequence[str], n_buckets: int | None = None,
                  out: str = "_bkt") -> DataFrame:
    """Cut rows into ranges of the whole sort key (sampled splitters), ``out`` = the
    range's number, and write them once to the checkpoint folder.

    Because every order column takes part, a value that most rows share in the
    leading column is still spread over many ranges. NULL sorts first, as in an
    ascending ORDER BY.
    """
    from epiframe.session import stored

    n = n_buckets or default_buckets(df)
    return stored(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()), "ranges")


def hash_bucket(h: Column, n_buckets: int) -> Column:
    """Top bits of a non-negative 63-bit hash: monotone in ``h``."""
    bits = int(math.log2(n_buckets))
    assert 1 << bits == n_buckets, "n_buckets must be a power of two"
    return F.shiftright(h, 63 - bits).cast("int") if bits else F.lit(0)


def positive_hash(cols: Sequence[Column | str], seed: int) -> Column:
    """A seeded 63-bit non-negative hash of the key columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), *cols), 1)


def quantile_bucket(df: DataFrame, col: str, n_buckets: int, out: str = "_bkt") -> DataFrame:
    """Bucket index by approximate quantiles of ``col`` (numeric).

    One pass computes at most ``n_buckets - 1`` boundaries (a bounded list on the
    driver); the bucket is then found by binary search in the JVM.
    """
    from pyspark.ml.feature import Bucketizer

    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.stat.approxQuantile(col, probs, 1.0 / (4 * n_buckets)) if probs else []
    bounds = sorted({float(b) for b in bounds if b is not None and not math.isnan(b)})
    splits = [-math.inf] + [b for b in bounds if math.isfinite(b)] + [math.inf]
    # NULL is a bucket of its own below all others: ascending orders put it first,
    # descending ones last
    null_first = F.when(F.col(col).isNull(), F.lit(-1))
    if len(splits) < 3:  # one bucket (Bucketizer needs at least two)
        return df.withColumn(out, null_first.otherwise(F.lit(0)))
    tmp = f"{out}_in"
    src = df.withColumn(tmp, F.col(col).cast("double"))
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(src).withColumn(out, null_first.otherwise(F.col(out).cast("int"))).drop(tmp)


def running_totals(df: DataFrame, by: Sequence[str], bucket: str | Sequence[str],
                   order: Sequence[Column], values: dict[str, Column],
                   descending: bool = False, bucket_bound: bool = True) -> DataFrame:
    """Add running sums (inclusive, rows frame) of ``values`` over ``order`` within
    ``by``. The bucket columns, compared in their listed order, must be
    non-decreasing along ``order`` (non-increasing when ``descending``).

    Plan: one exchange on (by, bucket) feeds a local window. Bucket totals
    (groups x buckets rows, after map-side partial aggregation) become offsets
    through a small window; with no ``by`` and ``bucket_bound`` they are
    broadcast back, otherwise joined on (by, bucket), the keys the local window
    is already partitioned on. The totals pass reads the input a second time
    with only the key columns (column pruning), which is cheap for stored
    tables; checkpoint an expensive derived input first (see the
    ``checkpoint_input`` options of the batching operators).
    """
    by = list(by)
    buckets = [bucket] if isinstance(bucket, str) else list(bucket)
    keys = [*by, *buckets]
    staged = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    w_local = (Window.partitionBy(*keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = staged.select("*", *[F.sum(f"_v_{k}").over(w_local).alias(f"_l_{k}") for k in values])
    totals = local.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    b_order = [F.col(b).desc() if descending else F.col(b).asc() for b in buckets]
    w_off = Window.partitionBy(*by).orderBy(*b_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[
        F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_off_{k}") for k in values])
    if not by and bucket_bound:
        offsets = F.broadcast(offsets)
    # NULL keys are groups like any other
    offsets = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_off_{k}" for k in values])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(offsets, same).drop(*[f"_k_{k}" for k in keys])
    out = joined.select("*", *[(F.col(f"_l_{k}") + F.col(f"_off_{k}")).alias(k) for k in values])
    drop = [f"_{p}_{k}" for k in values for p in ("v", "l", "off")] + \
        [b for b in buckets if b.startswith("_")]
    return out.drop(*drop)


def ordered_index(df: DataFrame, order: Sequence[Column], bucket: Column,
                  by: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """1-based row number along ``order`` within ``by``; ``bucket`` must be
    non-decreasing along ``order``. ``order`` must be a total order (add key
    columns as tie-breakers) for the numbering to be deterministic."""
    staged = df.withColumn("_bkt", bucket)
    return running_totals(staged, by, "_bkt", order, {name: F.lit(1).cast("bigint")})


def cumulative_by_score(agg: DataFrame, score: str, values: Sequence[str],
                        by: Sequence[str] = (), descending: bool = True,
                        n_buckets: int | None = None) -> DataFrame:
    """Running sums of ``values`` over ``score`` (one row per group and distinct
    score) in descending (default) score order; output columns ``cum_<value>``.

    Ties must already be aggregated, so a score held by a third of all rows is one
    row here. Buckets come from score quantiles shared by all groups, so a large
    group is spread over many tasks.
    """
    n = n_buckets or default_buckets(agg)
    bucketed = quantile_bucket(agg, score, n)
    order = [F.col(score).desc() if descending else F.col(score).asc()]
    return running_totals(bucketed, by, "_bkt", order,
                          {f"cum_{v}": F.col(v) for v in values}, descending=descending)


def string_prefix_key(col: Column | str, n_bytes: int = 7) -> Column:
    """Non-negative BIGINT of the first ``n_bytes`` UTF-8 bytes (zero padded).

    Spark orders strings by their UTF-8 bytes, so this key never decreases along
    the string order: a usable bucket key for ordering strings.
    """
    c = F.col(col) if isinstance(col, str) else col
    head = F.hex(F.substring(F.encode(c, "UTF-8"), 1, n_bytes))
    return F.conv(F.rpad(head, 2 * n_bytes, "0"), 16, 10).cast("bigint")


def dense_codes(df: DataFrame, col: str, name: str = "code",
                n_buckets: int | None = None) -> DataFrame:
    """Number the distinct values of a string column 1..n in string order.

    NULL gets no code. Distributed: the distinct values are cut into ranges of the
    whole string, each range is numbered by its own window, and range sizes (one
    row per range) give the offsets.
    """
    staged = range_buckets(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], n_buckets)
    out = running_totals(staged, [], "_bkt", [F.col(col)], {name: F.lit(1).cast("bigint")})
    return out.select(col, F.col(name).cast("int").alias(name))
