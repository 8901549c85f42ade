"""Split labelled lines into classes by their last tab field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.sources.sinks import write_lines


def last_field_label(col: str = "value"):
    """INT of the last tab field, not stripped first. Like ``int()`` it accepts
    surrounding whitespace and fails the job on a blank or non-integer field,
    whatever the session's ANSI setting."""
    field = F.element_at(F.split(F.col(col), "\t"), -1)
    v = field.try_cast("int")
    return F.when(v.isNull(), F.raise_error(F.concat(
        F.lit("label is not an integer in line: "), F.col(col)))).otherwise(v)


def split_by_label(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of class 1 or 0 with their ``label``; other labels are dropped, as in
    the reference (see :func:`dropped_lines`)."""
    return lines.withColumn("label", last_field_label(col)).filter(F.col("label").isin(0, 1))


def positives(lines: DataFrame, col: str = "value") -> DataFrame:
    return split_by_label(lines, col).filter(F.col("label") == 1)


def negatives(lines: DataFrame, col: str = "value") -> DataFrame:
    return split_by_label(lines, col).filter(F.col("label") == 0)


def dropped_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines whose label is neither 0 nor 1 (silently lost by the split)."""
    return lines.withColumn("label", last_field_label(col)).filter(~F.col("label").isin(0, 1))


def write_split(lines: DataFrame, path: str, col: str = "value",
                extra_partitions: tuple = (), negative_fraction: float | None = None,
                key_cols: tuple | None = None, seed: int = 0) -> None:
    """One scan, both classes: ``<path>/label=1`` and ``<path>/label=0``.

    With ``negative_fraction`` the negatives are down-sampled in the same scan
    (the reference splits, then samples in a second job): by a hash of
    ``key_cols`` when given (layout-stable), else by ``rand(seed)``.
    """
    from epiframe.operators.sampling import downsample_class, downsample_class_bernoulli

    out = split_by_label(lines, col)
    if negative_fraction is not None:
        if key_cols:
            out = downsample_class(out, "label", list(key_cols), negative_fraction, 0, seed)
        else:
            out = downsample_class_bernoulli(out, "label", negative_fraction, 0, seed)
    write_lines(out, path, col=col, partition_by=[*extra_partitions, "label"])
