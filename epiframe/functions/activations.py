"""Scalar activations and the logistic loss term as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def relu(x: Column | str) -> Column:
    return F.greatest(_col(x), F.lit(0.0))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def sigmoid_log_loss(label: Column | str, logit: Column | str) -> Column:
    """Numerically stable sigmoid cross-entropy of one example."""
    x, y = _col(logit).cast("double"), _col(label).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
