"""The pipeline's stages, one by one."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from epiframe.llm.common import materialise
from epiframe.llm.pieces import DEFAULT_MODEL, Transducer

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, SF), "test-stage")
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count()
        ids = before.select("doc_id")
        assert after.join(ids, "doc_id", "left_anti").count() == 0
        before = after
    last = pipeline.STAGES[-1][1](spark, before, SF)
    with open(DEFAULT_MODEL, "rb") as f:
        fst = Transducer(f.read())
    want = {r["doc_id"]: fst.encode(r["text"]) for r in before.collect()}
    assert {r["doc_id"]: r["ids"] for r in last.collect()} == want


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(1)
    text = " ".join(f"word{rng.randint(0, 9999)}" for _ in range(60))
    rows = [(1, text, "en", "s1", 5), (2, None, None, None, None), (None, text + " more", "en", None, 1),
            (3, "", "en", "s1", 0), (1, text, "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumn("n_words", F.lit("clash")).withColumn("domain", F.lit("clash")).withColumn("_row", F.lit("clash"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "test-odd")
        assert "n_words" in docs.columns and "domain" in docs.columns
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_removes_what_it_wrote_on_the_way(spark):
    import os

    from epiframe.session import checkpoint_root, local_path
    folder = os.path.join(local_path(checkpoint_root(spark)), "epiframe")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    out = pipeline.run(spark, SF)
    left = {p.rsplit("-", 1)[0] for p in set(os.listdir(folder)) - before}
    assert left - {"pyfiles-local"} == {"pipeline-source-mixing"}
    assert out.count() > 0
