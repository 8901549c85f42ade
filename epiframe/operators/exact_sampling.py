"""Exact-size down-sampling (B3): the k rows of least hash of every group, without a sort.

The k-th smallest hash of a group is found by refining histograms: rows are counted by
the next ``BITS`` bits of their order key (a map-side combined count of groups x 2^BITS
rows), the bin in which the count passes k is kept, and only its rows are counted on, until
no bin holds more than ``LIMIT`` rows. Those are ranked within their group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators.sampling import key_hash60
from epiframe.plans.joins import sized_broadcast
from epiframe.session import stored

BITS = 12
LIMIT = 10_000
HASH_BITS, ID_BITS = 60, 63


def _cut(rows: DataFrame, bins: DataFrame, group: list[str]) -> DataFrame:
    """Per group: the bin in which the running count passes ``k`` (``at``), and how many
    rows are still wanted in it (``rest``). At most 2^BITS rows a group are ordered."""
    w = Window.partitionBy(*group).orderBy("bin")
    run = bins.withColumn("upto", F.sum("n").over(w))
    return run.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))) \
        .select(*group, F.col("bin").alias("at"), (F.col("k") - F.col("upto") + F.col("n")).alias("rest"), F.col("n").alias("held"))


def downsample_exact(df: DataFrame, label: str, keys: Sequence[str], fraction: tuple[int, int],
                     sampled_value=0, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """All rows of other classes, and of each group's (``by``) rows with ``label`` =
    ``sampled_value`` exactly ``round(n * fraction)`` (halves up): those with the least
    seeded hash of ``keys``.

    ``fraction`` is (numerator, denominator). A NULL label is another class and is kept;
    NULL groups and NULL keys are groups and keys like any other. Rows with equal keys tie
    and any of them may go, so the number is exact all the same. An empty table stays
    empty.
    """
    num, den = fraction
    names = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    groups = [F.col(c) for c in by] or [F.lit(0)]
    wanted = F.col(label).eqNullSafe(F.lit(sampled_value))
    # NULL groups compare as text '~', others as '=' + text
    as_key = [F.coalesce(F.concat(F.lit("="), g.cast("string")), F.lit("~")).alias(n) for g, n in zip(groups, names)]
    hashed = key_hash60([F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], seed)
    slim = stored(df.where(wanted).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *as_key, hashed.alias("h"),
        F.monotonically_increasing_id().alias("id")), "exact-rows")
    sizes = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    k = F.expr(f"(2L * n * {num} + {den}) div {2 * den}")
    goal = sizes.select(*names, k.alias("k")).where("k > 0")
    taken = []
    left = slim.join(sized_broadcast(goal), names)
    words = [("h", HASH_BITS), ("id", ID_BITS)]
    for col, bits in words:
        at = bits
        while at > 0:
            at = max(0, at - BITS)
            staged = left.withColumn("bin", F.shiftright(F.col(col), at))
            bins = staged.groupBy(*names, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
            cut = stored(_cut(left, bins, names), "exact-cut")
            joined = staged.join(sized_broadcast(cut), names)
            taken.append(joined.where("bin < at").select("row"))
            left = joined.where("bin = at").select("row", *names, "h", "id", F.col("rest").alias("k"))
            most = cut.agg(F.max("held").alias("m")).first()["m"] or 0
            if most <= LIMIT:
                break
            left = stored(left, "exact-left")
        if most <= LIMIT:
            break
    order = Window.partitionBy(*names).orderBy("h", "id")  # at most LIMIT rows a group
    taken.append(left.withColumn("r", F.row_number().over(order)).where("r <= k").select("row"))
    out = df.where(~wanted)
    for t in taken:
        out = out.unionByName(t.select("row.*"))
    return out
