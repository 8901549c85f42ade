"""Scoring with its figures gathered on the way (A1, A2 beside M6 and W3).

``write_scored`` scores, writes and counts in one job: an ``Observation`` sits between
the model step and the writer, so class counts, mean loss and the range of scores cost
no second pass over the examples or the written table. The figures are accumulated in
the writing stage, where Spark adds a partition's figures once, for the attempt that it
commits; a task lost and run again does not count twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from epiframe.functions.activations import sigmoid_log_loss
from epiframe.operators.scoring import ScorerConfig, Weights, score_examples
from epiframe.sources.sinks import MAX_RECORDS_PER_FILE

FIGURES = ("n_rows", "n_pos", "n_neg", "log_loss", "least_score", "largest_score", "n_bad")


def figures(label: str = "label", score: str = "score") -> list[Column]:
    """The aggregates of :data:`FIGURES`. ``n_bad`` counts rows whose label is not 0 or 1
    or whose score is NULL or not finite; the other figures leave these rows out, but for
    ``n_rows``. Without a good row the loss and the scores are NULL."""
    y, s = F.col(label), F.col(score).cast("double")
    good = F.coalesce(y.isin(0, 1) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")), F.lit(False))
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(good & (y == 1)).alias("n_pos"),
            F.count_if(good & (y == 0)).alias("n_neg"), F.avg(F.when(good, sigmoid_log_loss(y, s))).alias("log_loss"),
            F.min(F.when(good, s)).alias("least_score"), F.max(F.when(good, s)).alias("largest_score"),
            F.count_if(~good).alias("n_bad")]


def write_scored(df: DataFrame, weights: Weights, path: str, cfg: ScorerConfig | None = None,
                 label: str = "label", vec: str = "vec", out: str = "score",
                 partition_by: Sequence[str] = (), strict: bool = True) -> tuple[DataFrame, dict]:
    """Score ``df``, write it below ``path`` and return (written table, figures).

    With ``strict`` a label other than 0 or 1 or a score that is not a number fails
    after the write (the rows are there to be looked at); else ``n_bad`` reports them.
    An empty input writes an empty table: counts 0, the other figures None.
    """
    seen = Observation()
    scored = score_examples(df, weights, cfg, vec, out)
    writer = scored.observe(seen, *figures(label, out)).write.mode("errorifexists") \
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    got = {k: seen.get[k] for k in FIGURES}
    if strict and got["n_bad"]:
        raise ValueError(f"{got['n_bad']} rows with a label other than 0 or 1 or without a score in {path}")
    return df.sparkSession.read.schema(scored.schema).parquet(path), got
