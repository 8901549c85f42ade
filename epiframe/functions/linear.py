"""Affine layers as Spark expressions (M1/M2 for small layers).

``affine`` writes every output as an explicit sum of products, so whole-stage
codegen compiles it; it is meant for small layers (the abundance branch is
1 -> 16 -> 1). Wide layers (one-hot -> 256) run in NumPy on Arrow batches, see
``epiframe.operators.scoring.linear_layer``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions.activations import relu, sigmoid


def affine(vec: Column | str, W, b, activation: str | None = None) -> Column:
    """ARRAY<DOUBLE> ``activation(vec @ W + b)`` for a vector column of length
    ``W.shape[0]``; ``activation`` is None, "relu" or "sigmoid"."""
    W, b = np.asarray(W, dtype=np.float64), np.asarray(b, dtype=np.float64)
    n_in, n_out = W.shape
    v = F.col(vec) if isinstance(vec, str) else vec
    xs = [F.get(v, i).cast("double") for i in range(n_in)]
    outs = []
    for j in range(n_out):
        acc = F.lit(float(b[j]))
        for i in range(n_in):
            if W[i, j] != 0.0:
                acc = acc + xs[i] * F.lit(float(W[i, j]))
        if activation == "relu":
            acc = relu(acc)
        elif activation == "sigmoid":
            acc = sigmoid(acc)
        elif activation is not None:
            raise ValueError(f"unknown activation {activation!r}")
        outs.append(acc)
    return F.array(*outs)
