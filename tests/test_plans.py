"""Plan properties that matter at scale, checked on the small fixture."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def reg():
    from epiframe import registry

    return registry


def test_encoding_stays_in_the_jvm(spark, reg):
    plan = _plan(reg.q_assemble17(spark, SF))
    for node in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan
    assert "BroadcastHashJoin" in plan
    # the document text never crosses an exchange: only the word rows are joined
    assert "SortMergeJoin" not in plan


def test_scan_reads_only_needed_columns(spark, reg):
    plan = _plan(reg.q_sample_hash(spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("l_extendedprice" not in s and "l_shipdate" not in s for s in schemas)


def test_metric_windows_are_bucketed(spark):
    from pyspark.sql import functions as F

    from epiframe.operators import metrics

    df = spark.range(0, 3000).select(
        (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 97).cast("double").alias("score"))
    out = metrics.roc_auc(df)
    plan = _plan(out)
    # the per-row running sums are partitioned by the score bucket, so no task
    # ever holds every distinct score
    assert re.search(r"Window \[[^\]]*\], \[_bkt", plan) or "hashpartitioning(_bkt" in plan


def test_hash_sample_plan_has_no_shuffle(spark, reg):
    plan = _plan(reg.q_sample_hash(spark, SF))
    assert "Exchange" not in plan


def test_scoring_keeps_python_to_one_node(spark, reg):
    plan = _plan(reg.q_masked_score(spark, SF))
    assert plan.count("MapInArrow") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_small_layers_stay_in_the_jvm(spark, reg):
    plan = _plan(reg.q_linear(spark, SF))
    assert "MapInArrow" not in plan and "EvalPython" not in plan


def test_fit_step_reads_one_batch(spark):
    """A fit step's batch filter reaches the Parquet scan."""
    import numpy as np
    from pyspark.sql import functions as F

    from epiframe.operators import batching, scoring

    cfg = scoring.ScorerConfig("base", hidden=4, categories=30)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(0, 21, 11)] + [1.0] * 6, int(i % 3 == 0))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id int, vec array<double>, label int")
    b = batching.balanced_batches(df, "label", ["id"], 20, seed=1)
    plans = []
    orig = scoring.gradient_sums

    def spy(part, *a, **k):
        plans.append(part._jdf.queryExecution().executedPlan().toString())
        return orig(part, *a, **k)

    scoring.gradient_sums = spy
    try:
        scoring.fit_scorer(b, cfg, steps=2, batch_col="batch", dropout=False)
    finally:
        scoring.gradient_sums = orig
    assert plans and all("PushedFilters: [IsNotNull(batch), EqualTo(batch," in p for p in plans)
