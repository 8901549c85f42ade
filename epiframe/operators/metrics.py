"""Evaluation: class counts, log loss, ROC-AUC and PR-AUC, overall or per group (A1-A5).

Scores are first aggregated to one row per (group, distinct score) with the
positive and negative counts, so ties and hot scores collapse before anything is
ordered. The running counts over descending scores come from the two-level plan
in :mod:`epiframe.plans.ordering`; the areas are then plain sums.

* ROC-AUC counts a tied (positive, negative) pair as one half.
* PR-AUC uses the "careful" interpolation between thresholds (Davis and
  Goadrich, ICML 2006): precision is interpolated along the line of true
  positives against predicted positives, giving per segment
  ``slope * (dtp + b * ln(p1 / p0)) / P`` with ``slope = dtp / dp`` and
  ``b = tp0 - slope * p0``; the first segment (``p0 = 0``) has no log term.
  One threshold per distinct score, so the area is exact, not binned.
* A group with no positives or no negatives gets area 0, as a thresholded
  counter does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions.activations import sigmoid_log_loss
from epiframe.plans.ordering import cumulative_by_score


def class_counts(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def score_counts(df: DataFrame, label: str = "label", score: str = "score",
                 by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, score): positives and negatives at that score.

    A label other than 0 or 1 and a NULL score fail the job; filter such rows first
    if they are expected. A NULL group is a group of its own.
    """
    good = F.col(label).isin(0, 1) & F.col(score).isNotNull()
    y = F.when(F.coalesce(good, F.lit(False)), F.col(label).cast("long")).otherwise(F.raise_error(F.concat(
        F.lit("label must be 0 or 1 and score not NULL: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")),
        F.lit(", "), F.coalesce(F.col(score).cast("string"), F.lit("NULL")))).cast("long"))
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def auc_summary(df: DataFrame, label: str = "label", score: str = "score",
                by: Sequence[str] = (), checkpoint: bool = True) -> DataFrame:
    """Per group: n_pos, n_neg, roc_auc, pr_auc, log_loss (score used as logit)."""
    by = list(by)
    agg = score_counts(df, label, score, by)
    if checkpoint:
        # Cut lineage: the score quantiles and the running sums both read the
        # aggregate, which is written once to the shared checkpoint folder
        # instead of re-scoring the input twice.
        from epiframe.session import stored

        agg = stored(agg, "score-counts")
    cum = cumulative_by_score(agg, "score", ["pos", "neg"], by=by, descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cpos, cneg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    p1 = cpos + cneg
    p0 = p1 - pos - neg
    tp0 = cpos - pos
    slope = pos / (pos + neg)
    intercept = tp0 - slope * p0
    ratio = F.when((p0 > 0) & (p1 > 0), p1 / p0).otherwise(F.lit(1.0))
    pr_term = slope * (pos + intercept * F.log(ratio))
    loss = pos * sigmoid_log_loss(F.lit(1), "score") + neg * sigmoid_log_loss(F.lit(0), "score")
    sums = cum.groupBy(*by).agg(
        F.sum(pos).alias("P"), F.sum(neg).alias("N"),
        F.sum(pos * cneg).alias("pos_x_cneg"), F.sum(pos * neg).alias("pos_x_neg"),
        F.sum(pr_term).alias("pr_num"), F.sum(loss).alias("loss_sum"))
    P, N = F.col("P"), F.col("N")
    roc = F.when((P > 0) & (N > 0),
                 (P * N - F.col("pos_x_cneg") + 0.5 * F.col("pos_x_neg")) / (P * N)
                 ).otherwise(F.lit(0.0))
    pr = F.when(P > 0, F.col("pr_num") / P).otherwise(F.lit(0.0))
    return sums.select(*by, P.cast("long").alias("n_pos"), N.cast("long").alias("n_neg"),
                       roc.alias("roc_auc"), pr.alias("pr_auc"),
                       (F.col("loss_sum") / (P + N)).alias("log_loss"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            by: Sequence[str] = ()) -> DataFrame:
    return auc_summary(df, label, score, by).select(*by, "roc_auc")


def pr_auc(df: DataFrame, label: str = "label", score: str = "score",
           by: Sequence[str] = ()) -> DataFrame:
    return auc_summary(df, label, score, by).select(*by, "pr_auc")


def mean_log_loss(df: DataFrame, label: str = "label", logit: str = "score",
                  by: Sequence[str] = ()) -> DataFrame:
    """Mean sigmoid cross-entropy; a plain grouped average, no ordering needed."""
    return df.groupBy(*by).agg(F.avg(sigmoid_log_loss(label, logit)).alias("log_loss"))


def evaluate_by_sample(df: DataFrame, label: str = "label", score: str = "score",
                       sample: str = "sample_id") -> DataFrame:
    """A3 + A4 (+ log loss and class sizes) per held-out sample."""
    return auc_summary(df, label, score, by=[sample])
