"""Thresholded ROC and PR areas with an error bound (A3, A4).

Scores are counted into fixed bins in one pass with map-side combine; two tables of counts
merge by addition, so the curves of a stream or of several days follow from their bins.
Within a bin the order of the rows is not known: the exact area (ties counted one half in
ROC, careful interpolation in PR) lies between the area with every negative of a bin first
and the one with every positive first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BINS = 200


def score_bins(df: DataFrame, low: float, high: float, bins: int = DEFAULT_BINS, label: str = "label",
               score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, pos, neg): counts of the classes in ``bins`` equal bins of low..high;
    scores beyond fall into the outer bins. Rows with a NULL label or score do not count;
    NaN counts as the highest score."""
    s, width = F.col(score).cast("double"), (high - low) / bins
    at = F.when(F.isnan(s), F.lit(bins - 1)).otherwise(
        F.least(F.greatest(F.floor((s - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))).cast("int")
    return df.where(F.col(label).isNotNull() & s.isNotNull()).groupBy(*by, at.alias("bin")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def merge_bins(*parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of several tables of :func:`score_bins` with the same bins."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _step(pos: Column, neg: Column, tp: Column, fp: Column) -> Column:
    """Careful interpolation of precision over recall while ``pos`` positives and ``neg``
    negatives come in evenly after ``tp`` and ``fp`` of them, times all positives."""
    p0, p1 = tp + fp, tp + fp + pos + neg
    slope = pos / (pos + neg)
    log = F.when((p0 > 0) & (p1 > 0), F.log(p1 / p0)).otherwise(F.lit(0.0))
    return F.when(pos > 0, slope * (pos + (tp - slope * p0) * log)).otherwise(F.lit(0.0))


def binned_areas(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pos, n_neg, roc_auc, roc_bound, pr_auc, pr_low, pr_high) of binned counts.

    The exact ROC area differs from ``roc_auc`` by at most ``roc_bound``; the exact PR
    area lies in ``pr_low`` .. ``pr_high``. A group of one class has ROC area 0 (PR area 1
    with positives only, 0 without), and bound 0. At most one row a bin is ordered.
    """
    counts = merge_bins(bins, by=by)
    w = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumn("cp", F.sum("pos").over(w).cast("double")).withColumn("cn", F.sum("neg").over(w).cast("double"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("cp") - pos, F.col("cn") - neg
    zero = F.lit(0.0)
    even = _step(pos, neg, tp, fp)
    best = _step(pos, zero, tp, fp)
    worst = _step(pos, zero, tp, F.col("cn"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    agg = c.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(pos * F.col("cn")).alias("lost"),
        F.sum(pos * neg).alias("tied"), F.sum(even).alias("even"), F.sum(best).alias("best"), F.sum(worst).alias("worst"))

    def share(c: str) -> Column:
        return F.when(F.col("n_pos") > 0, F.col(c) / F.col("n_pos")).otherwise(zero)
    return agg.select(
        *by, "n_pos", "n_neg",
        F.when(both, (pairs - F.col("lost") + 0.5 * F.col("tied")) / pairs).otherwise(zero).alias("roc_auc"),
        F.when(both, 0.5 * F.col("tied") / pairs).otherwise(zero).alias("roc_bound"),
        share("even").alias("pr_auc"), share("worst").alias("pr_low"), share("best").alias("pr_high"))
