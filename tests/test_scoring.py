import numpy as np
import pytest

from epiframe.operators import scoring


def _batch(cfg, n=40, seed=0):
    rng = np.random.default_rng(seed)
    pep = rng.integers(0, cfg.depth + 1, size=(n, 11))
    al = np.sort(rng.integers(0, 30, size=(n, 6)), axis=1)
    cols = [pep, al]
    if cfg.spec["abundance"]:
        cols.append(rng.uniform(0, 3, size=(n, 1)))
    if cfg.spec["flank"]:
        cols.append(rng.integers(0, cfg.depth, size=(n, 10)))
    return np.hstack(cols).astype(float), rng.integers(0, 2, n).astype(float)


@pytest.mark.parametrize("variant", ["base", "abundance", "flank"])
def test_gradient_matches_finite_differences(variant):
    cfg = scoring.ScorerConfig(variant, hidden=8, categories=30)
    w = scoring.random_weights(cfg, seed=1)
    for k in w.arrays:
        w.arrays[k] = w.arrays[k] + 0.05
    X, y = _batch(cfg)

    def loss(wt):
        s, _ = scoring.forward(wt, X, cfg)
        return scoring.log_loss_terms(y, s).sum()

    s, cache = scoring.forward(w, X, cfg)
    g = scoring.backward(w, cache, y, s, cfg)
    rng = np.random.default_rng(3)
    for name in w.arrays:
        a = w.arrays[name]
        for _ in range(3):
            idx = tuple(rng.integers(0, d) for d in a.shape)
            wp, wm = w.copy(), w.copy()
            wp.arrays[name][idx] += 1e-6
            wm.arrays[name][idx] -= 1e-6
            num = (loss(wp) - loss(wm)) / 2e-6
            assert g[name][idx] == pytest.approx(num, rel=1e-4, abs=1e-6), name


def test_score_in_range_and_spark_equals_numpy(spark):
    cfg = scoring.ScorerConfig("abundance", hidden=16, categories=30)
    w = scoring.rule_weights(cfg)
    X, y = _batch(cfg, n=50)
    s_np, _ = scoring.forward(w, X, cfg)
    assert (s_np >= 0).all() and (s_np <= 6).all()
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(len(X))],
                               "id int, vec array<double>, label int")
    out = {r["id"]: r["score"] for r in scoring.score_examples(df, w, cfg).collect()}
    assert np.allclose([out[i] for i in range(len(X))], s_np, atol=1e-12)
    sums = scoring.gradient_sums(df.repartition(3), w, cfg)
    g, loss, rows = scoring.collect_gradient(sums, w)
    _, cache = scoring.forward(w, X, cfg)
    ref = scoring.backward(w, cache, y, s_np, cfg)
    assert rows == 50
    assert np.allclose(g.arrays["W2"], ref["W2"], atol=1e-9)


def test_dropout_mask_deterministic():
    h = np.arange(100, dtype=np.int64).view(np.uint64)
    a = scoring.dropout_mask(h, 256, 3, 0.75)
    b = scoring.dropout_mask(h, 256, 3, 0.75)
    c = scoring.dropout_mask(h, 256, 4, 0.75)
    assert (a == b).all() and not (a == c).all()
    assert abs((a > 0).mean() - 0.75) < 0.02
    assert set(np.unique(a)) <= {0.0, 1 / 0.75}


def test_fit_reduces_loss(spark):
    cfg = scoring.ScorerConfig("base", hidden=16, categories=30)
    X, _ = _batch(cfg, n=300, seed=5)
    y = (X[:, 0] > cfg.depth / 2).astype(int)          # learnable from the first residue
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(len(X))],
                               "id int, vec array<double>, label int")
    _, hist = scoring.fit_scorer(df, cfg, steps=25, lr=0.05, seed=0, keys=["id"], dropout=False)
    assert hist[-1][1] < hist[0][1]


def test_fit_on_balanced_batches(spark):
    from epiframe.operators.batching import balanced_batches

    cfg = scoring.ScorerConfig("base", hidden=16, categories=30)
    X, _ = _batch(cfg, n=400, seed=6)
    y = (X[:, 0] > cfg.depth / 2).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(len(X))],
                               "id int, vec array<double>, label int")
    b = balanced_batches(df, "label", ["id"], 50, seed=1)
    _, hist = scoring.fit_scorer(b, cfg, steps=4, lr=0.05, keys=["id", "slot"], batch_col="batch")
    assert [h[2] for h in hist] == [100, 100, 100, 100]


def test_fit_resumes_from_saved_state(spark, scratch):
    cfg = scoring.ScorerConfig("base", hidden=8, categories=30)
    X, y = _batch(cfg, n=120, seed=8)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(len(X))],
                               "id int, vec array<double>, label int")
    full, hist_full = scoring.fit_scorer(df, cfg, steps=4, lr=0.05, dropout=False)
    path = scratch("fit-state")
    scoring.fit_scorer(df, cfg, steps=2, lr=0.05, dropout=False, save_path=path)
    resumed, hist = scoring.fit_scorer(df, cfg, steps=4, lr=0.05, dropout=False, save_path=path)
    assert [h[0] for h in hist] == [2, 3]
    assert np.allclose(resumed.flat(), full.flat())


def test_affine_expression_equals_arrow_layer(spark):
    from epiframe.functions import affine

    rng = np.random.default_rng(4)
    W, b = rng.normal(size=(3, 5)), rng.normal(size=5)
    X = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(20)], "id int, x array<double>")
    a = {r["id"]: r["y"] for r in df.select("id", affine("x", W, b, "relu").alias("y")).collect()}
    c = {r["id"]: r["y"] for r in scoring.linear_layer(df, "x", W, b, "relu").collect()}
    ref = np.maximum(X @ W + b, 0)
    for i in range(20):
        assert np.allclose(a[i], ref[i]) and np.allclose(c[i], ref[i])
