"""Reconciliation, scattered gradients, barrier fits, counter-based random numbers, epoch
permutations, exact-size sampling and binned curves."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.functions import random as rnd
from epiframe.operators import barrier_fit, curves, epochs, exact_sampling, metrics, scoring
from epiframe.sources import dataset


# --- reconciliation --------------------------------------------------------------

def test_listing_sees_empty_files_and_reads_no_content(spark, scratch, tmp_path):
    for name, body in (("train/s1_pos.txt", "AB\t1\n"), ("train/s1_neg.txt", ""), ("train/s9_pos.txt", "x"),
                       ("test/s2_pos.txt", "y\n"), ("train/_SUCCESS", ""), ("train/notes.md", "n")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body)
    listing = dataset.file_listing(spark, str(tmp_path))
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split(">")[0]
    files = {(r["split"], r["file"]): (r["cls"], r["bytes"]) for r in dataset.listed_files(listing).collect()}
    assert files == {("train", "s1_pos"): ("pos", 5), ("train", "s1_neg"): ("neg", 0), ("train", "s9_pos"): ("pos", 1),
                     ("test", "s2_pos"): ("pos", 2)}
    man = dataset.dataset_manifest(spark.createDataFrame([("train", "s1"), ("test", "s2")], "split string, sample_id string"))
    found = dataset.listed_files(listing)
    status = {(r["split"], r["file"]): r["status"] for r in dataset.reconcile(man, found).collect()}
    assert status == {("train", "s1_pos"): "present", ("train", "s1_neg"): "empty", ("train", "s9_pos"): "surplus",
                      ("test", "s2_pos"): "present", ("test", "s2_neg"): "missing"}
    rep = {(r["split"], r["cls"]): r.asDict() for r in dataset.check_complete(man, found).collect()}
    assert rep["train", "pos"]["surplus"] == 1 and not rep["train", "pos"]["exact"]
    assert rep["train", "neg"]["empty"] == 1 and not rep["train", "neg"]["exact"]
    assert rep["test", "pos"]["exact"] and rep["test", "neg"]["missing"] == 1
    assert [r["file"] for r in dataset.surplus_files(man, found).collect()] == ["s9_pos"]
    with pytest.raises(AssertionError):
        dataset.assert_complete(dataset.check_complete(man, found))
    dataset.assert_complete(dataset.check_complete(man.where("split = 'test' and cls = 'pos'"), found.where("split = 'test'")))


def test_reconcile_takes_null_keys_and_repeated_files(spark):
    man = spark.createDataFrame([("a", None, "pos"), (None, "f_pos", "pos")], "split string, file string, cls string")
    found = spark.createDataFrame([(None, "f_pos"), (None, "f_pos"), ("a", None), ("b", "g_neg")], "split string, file string")
    got = sorted((str(r["split"]), str(r["file"]), r["cls"], r["status"]) for r in dataset.reconcile(man, found).collect())
    assert got == [("None", "f_pos", "pos", "present"), ("a", "None", "pos", "present"), ("b", "g_neg", "neg", "surplus")]
    assert dataset.check_complete(man, found.limit(0)).agg(F.sum("missing")).first()[0] == 2
    assert dataset.check_complete(man.limit(0), found.limit(0)).count() == 0


# --- scattered gradients ---------------------------------------------------------

def examples(spark, n=160, variant="flank", seed=1):
    rng = np.random.default_rng(seed)
    cfg = scoring.ScorerConfig(variant, hidden=12)
    rows = []
    for i in range(n):
        vec = list(map(float, np.r_[rng.integers(0, 20, 11), np.sort(rng.integers(0, 101, 6))]))
        vec += [float(rng.uniform(0, 5))] if cfg.spec["abundance"] else []
        vec += list(map(float, rng.integers(0, 23, 10))) if cfg.spec["flank"] else []
        rows.append((i, vec, int(rng.integers(0, 2)), i // 40))
    return cfg, spark.createDataFrame(rows, "id long, vec array<double>, label int, batch long")


@pytest.mark.parametrize("slice_size,fan_in", [(7, 3), (4096, 32), (100_000, 1)])
def test_scattered_gradient_equals_numpy(spark, slice_size, fan_in):
    cfg, df = examples(spark)
    w = scoring.random_weights(cfg, 3)
    names = sorted(w.arrays)
    rows = df.collect()
    want, loss = scoring.batch_gradient(w, np.array([r["vec"] for r in rows]), np.array([r["label"] for r in rows], float),
                                        cfg, names)
    sums = scoring.gradient_sums(df.repartition(5), w, cfg, slice_size=slice_size, fan_in=fan_in)
    g, got_loss, n = scoring.collect_gradient(sums, w)
    assert n == len(rows) and got_loss == pytest.approx(loss)
    assert np.allclose(g.flat(), want, atol=1e-9)
    parts = {(r["name"], r["i"], r["j"]): r["g"] for r in scoring.gradient_components(sums, w, slice_size).collect()}
    assert len(parts) == w.flat().size
    for k in names:
        a = g.arrays[k]
        for at in np.ndindex(a.shape):
            i, j = at if a.ndim == 2 else (at[0], 0)
            assert parts[k, i, j] == pytest.approx(a[at], abs=1e-9)


def test_no_reducer_adds_whole_models(spark):
    cfg, df = examples(spark)
    plan = scoring.gradient_sums(df, scoring.random_weights(cfg), cfg, slice_size=64)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(slice" in plan


def test_gradient_of_no_rows_is_zero(spark):
    cfg, df = examples(spark)
    w = scoring.random_weights(cfg)
    g, loss, rows = scoring.collect_gradient(scoring.gradient_sums(df.limit(0), w, cfg), w)
    assert rows == 0 and loss == 0.0 and not g.flat().any()


# --- barrier fits ----------------------------------------------------------------

@pytest.mark.parametrize("dropout", [False, True])
def test_barrier_fit_equals_the_stepwise_fit(spark, dropout):
    cfg, df = examples(spark, variant="abundance")
    kw = dict(lr=0.05, seed=4, keys=["id"], dropout=dropout, batch_col="batch")
    a, hist_a = scoring.fit_scorer(df, cfg, steps=6, **kw)
    b, hist_b = barrier_fit.fit_scorer_barrier(df, cfg, steps=6, steps_per_job=4, tasks=3, **kw)
    assert np.allclose(a.flat(), b.flat(), atol=1e-9)
    assert [(s, n) for s, _, n in hist_a] == [(s, n) for s, _, n in hist_b]
    assert np.allclose([h[1] for h in hist_a], [h[1] for h in hist_b], atol=1e-9)


def test_barrier_fit_goes_on_from_saved_state(spark, scratch):
    cfg, df = examples(spark, variant="base")
    kw = dict(steps_per_job=2, tasks=2, batch_col="batch", lr=0.05, seed=4, dropout=False)
    whole, hist = barrier_fit.fit_scorer_barrier(df, cfg, steps=5, **kw)
    path = scratch("barrier-state")
    barrier_fit.fit_scorer_barrier(df, cfg, steps=2, save_path=path, **kw)
    rest, later = barrier_fit.fit_scorer_barrier(df, cfg, steps=5, save_path=path, **kw)
    assert [h[0] for h in later] == [2, 3, 4] and later == hist[2:]
    assert np.allclose(whole.flat(), rest.flat(), atol=1e-12)


def test_barrier_fit_refuses_to_gather_too_much(spark):
    cfg, df = examples(spark, variant="base")
    with pytest.raises(ValueError, match="gather"):
        barrier_fit.fit_scorer_barrier(df, cfg, steps=1, steps_per_job=1, tasks=100_000, batch_col="batch")


# --- random numbers --------------------------------------------------------------

def test_draws_are_equal_in_spark_and_numpy(spark):
    hashes = [0, 1, 2 ** 32 - 1, 2 ** 32, 2 ** 60 - 1, 987654321987654321]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    for step in (0, 5, 2 ** 31 - 1):
        want = rnd.draw32_array(np.array(hashes, np.int64), 9, step)
        got = df.select("h", rnd.row_state(F.col("h"), F.lit(step)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("u")) \
            .select("h", "u", rnd.draw32(F.col("s"), F.col("u")).alias("x")).collect()
        assert {(r["h"], r["u"]): r["x"] for r in got} == {(h, u): int(want[i, u]) for i, h in enumerate(hashes) for u in range(9)}


def test_dropout_rows_are_the_mask_of_the_fit(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(50)] + [(None, None)], "a long, b string")
    from epiframe.operators.sampling import key_hash60
    hashes = {(r["a"], r["b"]): r["h"] for r in df.select("a", "b", key_hash60(["a", "b"], 9).alias("h")).collect()}
    rows = scoring.dropout_kept(df, ["a", "b"], 16, [0, 3], keep_prob=0.75, seed=9).collect()
    assert len(rows) == 51 * 16 * 2
    for step in (0, 3):
        keys = list(hashes)
        mask = scoring.dropout_mask(np.array([hashes[k] for k in keys]), 16, step, 0.75)
        got = {(r["a"], r["b"], r["unit"]): r["kept"] for r in rows if r["step"] == step}
        assert got == {(*k, u): bool(mask[i, u] > 0) for i, k in enumerate(keys) for u in range(16)}


def test_draws_look_random():
    h = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(4000)])
    x = rnd.draw32_array(h, 32, 1)
    kept = x < rnd.keep_threshold(0.75)
    assert abs(kept.mean() - 0.75) < 0.005
    assert abs(np.corrcoef(kept[:, 0], kept[:, 1])[0, 1]) < 0.06
    assert abs(np.corrcoef(kept.ravel(), (rnd.draw32_array(h, 32, 2) < rnd.keep_threshold(0.75)).ravel())[0, 1]) < 0.02
    bits = ((x[:, :, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)).mean((0, 1))
    assert np.abs(bits - 0.5).max() < 0.01


# --- permutations ----------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_and_equals_python(spark, n):
    keys = [0, 1, 123456789 % (1 << 28)]
    df = spark.range(n).crossJoin(spark.createDataFrame([(k,) for k in keys], "k long"))
    got = df.select("id", "k", rnd.permuted(F.col("id"), F.lit(n), F.col("k")).alias("p")).collect()
    for k in keys:
        at = {r["id"]: r["p"] for r in got if r["k"] == k}
        assert sorted(at.values()) == list(range(n))
        assert at == {x: rnd.permute(x, n, k) for x in range(n)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 10_007])
def test_permutation_of_arrays_equals_python(n):
    x, sizes = np.arange(2 * n) % n, np.full(2 * n, n)
    keys = np.repeat([5, (1 << 28) - 1], n)
    assert rnd.permuted_array(x, sizes, keys).tolist() == [rnd.permute(a, n, k) for a, k in zip(x.tolist(), keys.tolist())]


def test_permutation_of_null_is_an_error(spark):
    with pytest.raises(Exception, match="permutation of NULL"):
        spark.range(3).select(rnd.permuted(F.when(F.col("id") < 2, F.col("id")), F.lit(3), F.lit(1))).collect()


def test_permutations_differ_and_mix():
    n = 5000
    a, b = ([rnd.permute(x, n, k) for x in range(n)] for k in (77, 78))
    assert sum(x == y for x, y in zip(a, b)) < 20
    assert sum(x == p for x, p in enumerate(a)) < 20
    assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.06 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.06


def labelled(spark):
    rows = [(i, "x" if i < 57 else "y" if i < 80 else None) for i in range(83)]
    return spark.createDataFrame(rows, "id long, c string")


def test_epochs_are_permutations_and_batches_are_slices_of_the_endless_line(spark):
    numbered = epochs.numbered_classes(labelled(spark), "c", ["id"], seed=3)
    order = defaultdict(dict)
    for r in epochs.epoch_order(numbered, "c", 0, 40, seed=3).collect():
        assert r["position"] not in order[r["c"], r["epoch"]]
        order[r["c"], r["epoch"]][r["position"]] = r["id"]
    sizes = {"x": 57, "y": 23, None: 3}
    assert all(sorted(v) == list(range(sizes[c])) for (c, _), v in order.items()) and len(order) == 120
    assert order["x", 0] != order["x", 1] and order["y", 4] != order["y", 5]
    line = {c: [order[c, e][p] for e in range(40) for p in range(sizes[c])] for c in sizes}
    got = defaultdict(dict)
    for r in epochs.balanced_stream(numbered, "c", 10, 3, 9, seed=3).collect():
        got[r["c"], r["batch"]][r["slot"]] = r["id"]
    assert set(got) == {(c, b) for c in sizes for b in range(3, 9)}
    for (c, b), slots in got.items():
        assert [slots[i] for i in range(10)] == line[c][b * 10:b * 10 + 10]
    assert epochs.balanced_stream(numbered, "c", 10, 4, 4, seed=3).count() == 0


def test_a_small_class_is_dealt_by_chunks_of_epochs(spark, monkeypatch):
    numbered = epochs.numbered_classes(labelled(spark), "c", ["id"], seed=3)
    want = sorted(map(str, epochs.balanced_stream(numbered, "c", 30, 0, 5, seed=3).collect()))
    monkeypatch.setattr(epochs, "EPOCHS_PER_CHUNK", 4)
    assert sorted(map(str, epochs.balanced_stream(numbered, "c", 30, 0, 5, seed=3).collect())) == want
    far = epochs.balanced_stream(numbered, "c", 30, 10 ** 9, 10 ** 9 + 1, seed=3)
    assert far.groupBy("c").count().where("count = 30").count() == 3


def test_a_later_epoch_needs_no_exchange(spark):
    numbered = epochs.numbered_classes(labelled(spark), "c", ["id"], seed=3)
    extra = epochs.epoch_order(numbered, "c", 5, 6)._jdf.queryExecution().executedPlan().toString().count("Exchange") \
        - numbered._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert extra == 0


def test_places_are_computed_once_a_row_and_not_interpreted(spark):
    numbered = epochs.numbered_classes(labelled(spark), "c", ["id"], seed=3)
    stream = epochs.balanced_stream(numbered, "c", 10, 3, 9, seed=3).select("batch", "slot", "epoch", "c", "id")
    for df in (epochs.epoch_order(numbered, "c", 0, 3), stream):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1


# --- exact-size sampling -----------------------------------------------------------

@pytest.mark.parametrize("limit,bits", [(10_000, 12), (3, 4), (1, 2)])
def test_exact_sampling_takes_the_least_hashes(spark, monkeypatch, limit, bits):
    monkeypatch.setattr(exact_sampling, "LIMIT", limit)
    monkeypatch.setattr(exact_sampling, "BITS", bits)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None, "~"]), rng.choice([0, 0, 0, 1, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, g string, y int")
    got = [(r["id"], r["g"], r["y"]) for r in exact_sampling.downsample_exact(df, "y", ["id"], (3, 10), by=["g"], seed=5).collect()]

    def h(i):
        return int(hashlib.md5(f"{i}|5".encode()).hexdigest()[:15], 16)
    want = [r for r in rows if r[2] != 0]
    for g in ("a", "b", None, "~"):
        own = sorted((r for r in rows if r[2] == 0 and r[1] == g), key=lambda r: h(r[0]))
        want += own[:(2 * len(own) * 3 + 10) // 20]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [10_000, 2])
def test_exact_sampling_of_ties_nulls_and_hot_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_sampling, "LIMIT", limit)
    rows = [(1, 0)] * 40 + [(None, 0)] * 21 + [(2, 1)] * 5
    df = spark.createDataFrame(rows, "id long, y int").withColumns({c: F.lit(9) for c in ("h", "k", "n", "row", "bin", "_g0")})
    out = exact_sampling.downsample_exact(df, "y", ["id"], (1, 4))
    assert out.where("y = 0").count() == 15 and out.where("y = 1").count() == 5 and out.columns == df.columns
    assert exact_sampling.downsample_exact(df, "y", ["id"], (1, 1)).count() == 66
    assert exact_sampling.downsample_exact(df, "y", ["id"], (0, 1)).count() == 5
    assert exact_sampling.downsample_exact(df.limit(0), "y", ["id"], (1, 2)).count() == 0


# --- binned curves ---------------------------------------------------------------

def test_binned_areas_hold_the_exact_ones(spark):
    rng = random.Random(7)
    rows = [(s, int(rng.random() < 0.3 + 0.1 * s), max(0.0, min(1.0, rng.gauss(0.5 + 0.02 * s, 0.2)))) for s in range(4) for _ in range(300)]
    rows += [(8, 1, 0.4), (8, 1, 0.6), (9, 0, 0.1)]
    df = spark.createDataFrame(rows, "sample_id long, label int, score double")
    exact = {r["sample_id"]: r for r in metrics.evaluate_by_sample(df).collect()}
    widths = []
    for bins in (1, 4, 64, 4096):
        got = {r["sample_id"]: r for r in curves.binned_areas(curves.score_bins(df, 0, 1, bins, by=["sample_id"]), by=["sample_id"]).collect()}
        for s, r in got.items():
            assert abs(r["roc_auc"] - exact[s]["roc_auc"]) <= r["roc_bound"] + 1e-12
            assert r["pr_low"] - 1e-12 <= exact[s]["pr_auc"] <= r["pr_high"] + 1e-12
        widths.append((got[0]["roc_bound"], got[0]["pr_high"] - got[0]["pr_low"]))
    assert widths == sorted(widths, reverse=True) and widths[-1][0] < 0.01


def test_binned_counts_merge_and_take_odd_scores(spark):
    rows = [(1, 0.2), (0, float("nan")), (1, None), (None, 0.5), (0, -3.0), (1, 7.0), (1, 1.0)]
    df = spark.createDataFrame(rows, "label int, score double")
    parts = [curves.score_bins(df.limit(0), 0, 1, 10)] + [curves.score_bins(spark.createDataFrame([r], df.schema), 0, 1, 10) for r in rows]
    whole = sorted(map(tuple, curves.score_bins(df, 0, 1, 10).collect()))
    assert whole == [(0, 0, 1), (2, 1, 0), (9, 2, 1)] == sorted(map(tuple, curves.merge_bins(*parts).collect()))
    assert curves.binned_areas(curves.score_bins(df.limit(0), 0, 1, 10)).first()["n_pos"] in (None, 0)
