import numpy as np
import pytest

from epiframe.operators import metrics


def _roc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return 0.0
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _pr_integrate(y, s, steps=20000):
    """Numeric integral of the interpolated PR curve between distinct thresholds."""
    P = y.sum()
    total, tp_prev, p_prev = 0.0, 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = float(((s >= t) & (y == 1)).sum())
        p = float((s >= t).sum())
        xs = np.linspace(p_prev, p, steps)
        tps = tp_prev + (tp - tp_prev) * (xs - p_prev) / (p - p_prev)
        prec = np.where(xs > 0, tps / np.maximum(xs, 1e-300), 0.0)
        if p_prev == 0:
            prec = np.full_like(xs, (tp - tp_prev) / (p - p_prev))
        rec = tps / P
        total += np.trapezoid(prec, rec)
        tp_prev, p_prev = tp, p
    return total


def _df(spark, y, s, g=None):
    rows = [(int(a), float(b), int(c)) for a, b, c in zip(y, s, g if g is not None else [0] * len(y))]
    return spark.createDataFrame(rows, "label int, score double, sample_id int")


def test_roc_pr_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    s = np.round(rng.normal(size=600) + y * 0.7, 1)        # many ties
    out = metrics.auc_summary(_df(spark, y, s)).first()
    assert out["roc_auc"] == pytest.approx(_roc_brute(y, s), abs=1e-12)
    assert out["pr_auc"] == pytest.approx(_pr_integrate(y, s), abs=2e-4)
    ll = np.mean(np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s))))
    assert out["log_loss"] == pytest.approx(ll, abs=1e-12)


def test_reversed_tied_perfect_single_class(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = rng.normal(size=300)
    a = metrics.roc_auc(_df(spark, y, s)).first()[0]
    b = metrics.roc_auc(_df(spark, y, -s)).first()[0]
    assert a + b == pytest.approx(1.0, abs=1e-12)
    assert metrics.roc_auc(_df(spark, y, np.zeros(300))).first()[0] == pytest.approx(0.5)
    perfect = metrics.auc_summary(_df(spark, y, y.astype(float))).first()
    assert perfect["roc_auc"] == 1.0 and perfect["pr_auc"] == pytest.approx(1.0)
    one = metrics.auc_summary(_df(spark, np.ones(10), np.arange(10.0))).first()
    assert one["roc_auc"] == 0.0 and one["pr_auc"] == pytest.approx(1.0)


def test_by_sample_matches_per_group(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900)
    g = rng.integers(0, 3, 900)
    s = np.round(rng.normal(size=900) + y, 1)
    out = {r["sample_id"]: r for r in metrics.evaluate_by_sample(_df(spark, y, s, g)).collect()}
    for k in range(3):
        m = g == k
        assert out[k]["roc_auc"] == pytest.approx(_roc_brute(y[m], s[m]), abs=1e-12)
        assert out[k]["n_pos"] == int(y[m].sum())
