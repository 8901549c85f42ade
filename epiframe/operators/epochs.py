"""Endless, reshuffled class-balanced batches.

The rows of a class are numbered once, in a seeded hash order. In epoch e the row of
number r of a class of c rows stands at ``e c + permuted(r, c, key(seed, e, class))`` of
the class's endless slot line, so any range of batches, also of a far epoch, follows from
the numbered rows by arithmetic: no sort and no exchange an epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions.random import permutation_key, permuted
from epiframe.operators.batching import hash_order_index
from epiframe.plans.joins import sized_broadcast
from epiframe.session import stored

EPOCHS_PER_CHUNK = 1_000


def numbered_classes(df: DataFrame, label: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """``df`` with ``rn`` (from 1) and ``class_rows``, written once to the checkpoint
    folder; NULL is a class like any other."""
    numbered = stored(hash_order_index(df, label, keys, seed), "numbered")
    counts = numbered.groupBy(F.col(label).alias("_cls")).agg(F.count(F.lit(1)).alias("class_rows"))
    return numbered.join(sized_broadcast(counts), F.col(label).eqNullSafe(F.col("_cls"))).drop("_cls")


def epoch_order(numbered: DataFrame, label: str, first_epoch: int, last_epoch: int, seed: int = 0) -> DataFrame:
    """Every row once an epoch in ``first_epoch`` .. ``last_epoch - 1``, with ``epoch``
    and ``position`` (0 .. class_rows - 1, each once a class and epoch)."""
    rows = numbered.withColumn("epoch", F.explode(F.sequence(
        F.lit(first_epoch).cast("bigint"), F.lit(last_epoch - 1).cast("bigint"))))
    key = permutation_key(seed, F.col("epoch"), F.col(label))
    return rows.withColumn("position", permuted(F.col("rn") - 1, F.col("class_rows"), key))


def balanced_stream(numbered: DataFrame, label: str, n_per_class: int, first_batch: int, last_batch: int,
                    seed: int = 0) -> DataFrame:
    """Batches ``first_batch`` .. ``last_batch - 1`` of the endless line, each with exactly
    ``n_per_class`` rows of every class: the input's columns, ``batch``, ``slot`` and
    ``epoch``. A class of few rows takes part in many epochs; its rows are dealt to tasks
    by chunks of epochs first."""
    spark = numbered.sparkSession
    lo, hi = first_batch * n_per_class, last_batch * n_per_class
    if hi <= lo:
        return numbered.limit(0).select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("batch", "slot", "epoch")])
    c = F.col("class_rows")
    rows = numbered.withColumn("_e0", F.expr(f"{lo}L div class_rows")).withColumn("_e1", F.expr(f"({hi}L - 1) div class_rows"))
    few = rows.where(F.col("_e1") - F.col("_e0") < EPOCHS_PER_CHUNK)
    many = rows.where(F.col("_e1") - F.col("_e0") >= EPOCHS_PER_CHUNK) \
        .withColumn("_e0", F.explode(F.expr(f"sequence(_e0, _e1, {EPOCHS_PER_CHUNK}L)"))) \
        .withColumn("_e1", F.least(F.col("_e1"), F.col("_e0") + EPOCHS_PER_CHUNK - 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    many = many.repartition(parts, label, "rn", "_e0")
    each = few.unionByName(many).withColumn("epoch", F.explode(F.sequence("_e0", "_e1")))
    key = permutation_key(seed, F.col("epoch"), F.col(label))
    at = each.withColumn("_s", F.col("epoch") * c + permuted(F.col("rn") - 1, c, key)) \
        .where((F.col("_s") >= lo) & (F.col("_s") < hi))
    return at.select(*numbered.columns, F.expr(f"_s div {int(n_per_class)}").alias("batch"),
                     (F.col("_s") % n_per_class).alias("slot"), "epoch")
