"""Figures observed beside the write of scored rows."""

import numpy as np
import pytest

from epiframe.operators import metrics, observed, scoring

SCHEMA = "id long, sample_id long, label int, vec array<double>"


def _rows(n, seed=4):
    rng = np.random.default_rng(seed)
    pep, al = rng.integers(0, 21, (n, 11)), np.sort(rng.integers(0, 30, (n, 6)), axis=1)
    # sample 7 holds most rows
    return [(i, 7 if i % 5 else i % 3, int(rng.integers(0, 2)), [float(x) for x in (*pep[i], *al[i])]) for i in range(n)]


def _model():
    cfg = scoring.ScorerConfig("base", hidden=8, categories=30)
    return cfg, scoring.random_weights(cfg, seed=2)


@pytest.mark.parametrize("by", [(), ("sample_id", "label")])
def test_figures_equal_those_of_the_written_rows(spark, scratch, by):
    cfg, w = _model()
    rows = _rows(500)
    table, got = observed.write_scored(spark.createDataFrame(rows, SCHEMA).repartition(7), w, scratch("scored"), cfg,
                                       partition_by=by)
    s, _ = scoring.forward(w, np.array([r[3] for r in rows]), cfg)
    y = np.array([r[2] for r in rows])
    assert {r["id"]: r["score"] for r in table.collect()} == pytest.approx(dict(enumerate(s)))
    assert (got["n_rows"], got["n_pos"], got["n_neg"], got["n_bad"]) == (500, y.sum(), 500 - y.sum(), 0)
    assert got["log_loss"] == pytest.approx(scoring.log_loss_terms(y, s).mean())
    assert got["log_loss"] == pytest.approx(metrics.mean_log_loss(table).first()[0])
    assert (got["least_score"], got["largest_score"]) == pytest.approx((s.min(), s.max()))


def test_one_pass_over_the_examples(spark, scratch):
    """Every example row meets the model step once, although rows are written and counted."""
    cfg, w = _model()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    src = spark.createDataFrame(_rows(300), SCHEMA)
    _, got = observed.write_scored(src.mapInArrow(count, src.schema), w, scratch("scored"), cfg)
    assert got["n_rows"] == seen.value == 300


def test_bad_rows_and_empty_input(spark, scratch):
    cfg, w = _model()
    rows = [(i, s, None if i == 0 else 3 if i == 1 else y, v) for i, s, y, v in _rows(40)]
    src = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="2 rows"):
        observed.write_scored(src, w, scratch("scored"), cfg)
    table, got = observed.write_scored(src, w, scratch("scored"), cfg, strict=False)
    assert (got["n_rows"], got["n_bad"], got["n_pos"] + got["n_neg"], table.count()) == (40, 2, 38, 40)
    table, got = observed.write_scored(src.limit(0), w, scratch("scored"), cfg)
    assert table.count() == 0 and got == dict.fromkeys(observed.FIGURES, None) | dict.fromkeys(
        ("n_rows", "n_pos", "n_neg", "n_bad"), 0)
