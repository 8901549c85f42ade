"""Class-balanced and sequential batches.

Both number rows in a global order. The numbering uses the two-level plan of
:mod:`epiframe.plans.ordering`, so no single task sees a whole class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.operators.sampling import key_hash60
from epiframe.plans.joins import sized_broadcast
from epiframe.plans.ordering import default_buckets, ordered_index, range_buckets, running_totals
from epiframe.session import stored

# A row of a small class that fills more slots than this is first copied into chunks,
# which are dealt to many tasks, and then into slots.
SLOTS_PER_CHUNK = 10_000


def hash_order_index(df: DataFrame, label: str, keys: Sequence[str], seed: int,
                     n_buckets: int | None = None) -> DataFrame:
    """``rn`` (1-based) per class in the order of a seeded md5 hash of the key.

    The hash is uniform, so its top bits split every class evenly into buckets;
    the order does not depend on partitioning, so a retried task or a re-run
    numbers the rows the same way.
    """
    n = n_buckets or default_buckets(df)
    h = key_hash60(keys, seed)
    staged = df.withColumn("_h", h)
    # _h has 60 significant bits: shift so that the top log2(n) bits are kept.
    bits = int(math.log2(n))
    bucket = F.shiftright(F.col("_h"), 60 - bits).cast("int") if bits else F.lit(0)
    out = ordered_index(staged, [F.col("_h"), *[F.col(k) for k in keys]], bucket, by=[label])
    return out.drop("_h")


def balanced_batches(df: DataFrame, label: str, keys: Sequence[str], n_per_class: int,
                     seed: int = 0, checkpoint_input: bool = False) -> DataFrame:
    """Batches holding exactly ``n_per_class`` rows of every class.

    The number of batches is ``ceil(largest class / n)``. Slot ``s`` of a class
    (``batch = s div n``) takes that class's row ``s mod count`` in hash order, so
    a smaller class is cycled and the largest class wraps only in its last batch.
    Output: all input columns + ``batch``, ``slot`` (0..n-1), ``rn``.

    A row's slots follow from its number by arithmetic (rn - 1, rn - 1 + count, ...),
    so there is one pass over the numbered rows whatever the number of classes, and
    no join of slots; the class counts (one row per class) are joined, NULL being a
    class like any other.

    ``checkpoint_input`` writes the input once to the checkpoint folder first,
    for inputs that are expensive to derive (numbering reads them twice).
    """
    spark = df.sparkSession
    if checkpoint_input:
        df = stored(df, "batch-input")
    numbered = stored(hash_order_index(df, label, keys, seed), "numbered")
    counts = numbered.groupBy(F.col(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n").alias("n")).first()["n"] or 0
    total = -(-largest // n_per_class) * n_per_class
    rows = numbered.join(sized_broadcast(counts), F.col(label).eqNullSafe(F.col("_cls"))) \
        .withColumn("_times", F.expr(f"cast(ceil(({total} - rn + 1) / _n) as bigint)"))
    few = rows.where(F.col("_times") <= SLOTS_PER_CHUNK).withColumn("_from", F.lit(0).cast("bigint"))
    many = rows.where(F.col("_times") > SLOTS_PER_CHUNK) \
        .withColumn("_from", F.explode(F.expr(f"sequence(0L, _times - 1, {SLOTS_PER_CHUNK}L)")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    many = many.repartition(parts, "_cls", "rn", "_from")
    at = F.explode(F.expr(f"sequence(_from, least(_from + {SLOTS_PER_CHUNK - 1}L, _times - 1))"))
    slotted = few.unionByName(many).withColumn("_k", at).withColumn("_s", F.expr("rn - 1 + _k * _n"))
    return slotted.select(label, "rn", *[c for c in df.columns if c != label],
                          F.expr(f"_s div {int(n_per_class)}").alias("batch"),
                          (F.col("_s") % n_per_class).alias("slot"))


def sequential_batches(df: DataFrame, batch_rows: int, order: Sequence[str],
                       split_col: str, lead: Sequence[str] = (), by: Sequence[str] = (),
                       n_buckets: int | None = None, checkpoint_input: bool = False) -> DataFrame:
    """Unshuffled batches of ``batch_rows`` rows in the order (``lead``, ``order``).

    ``lead`` are leading sort columns (the class, as in "negatives file, then
    positives file"); ``order`` is the rest of the sort key and should make it
    unique; ``split_col`` must be its first column. Adds ``rn`` (1-based within
    ``by``) and ``batch``. NULL keys sort first and are numbered like all others.

    Rows are cut into ranges of the whole sort key, so a value shared by most rows
    is spread too. The input is read twice (splitters, ranges); ``checkpoint_input``
    writes it once to the checkpoint folder first, for inputs that are expensive to
    derive.
    """
    if split_col != order[0]:
        raise ValueError(f"split_col {split_col!r} is not the first order column {order[0]!r}")
    if checkpoint_input:
        df = stored(df, "batch-input")
    key = [*lead, *order]
    staged = range_buckets(df, key, n_buckets)
    out = running_totals(staged, list(by), "_bkt", [F.col(c) for c in key], {"rn": F.lit(1).cast("bigint")})
    return out.withColumn("batch", F.expr(f"(rn - 1) div {int(batch_rows)}"))
