"""NULL keys, labels and scores; hot keys; row keys; measured broadcasts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epiframe.operators import batching, metrics, sampling
from epiframe.operators.examples import encode_examples, encode_examples_checked
from epiframe.operators.lookup import encode_slots
from epiframe.plans.joins import sized_broadcast
from epiframe.plans.ordering import dense_codes, range_buckets
from epiframe.session import checkpoint_root
from epiframe.sources import text


@pytest.mark.parametrize("n_buckets", [1, 16])
def test_sequential_batches_keep_null_keys(spark, n_buckets):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"), "id",
                                  F.when(F.col("id") % 7 != 0, F.lit(1)).alias("g"))
    out = batching.sequential_batches(df, 50, order=["k", "id"], split_col="k", by=["g"], n_buckets=n_buckets)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    got = out.join(want.select("id", "w"), "id")
    assert out.count() == 1000
    assert got.where("rn <> w").count() == 0
    with pytest.raises(ValueError):
        batching.sequential_batches(df, 50, order=["k", "id"], split_col="id")


def test_hot_key_is_spread(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 15000, F.lit(3)).otherwise(F.col("id")).alias("k"), "id")
    largest = range_buckets(df, ["k", "id"], 16).groupBy("_bkt").count().agg(F.max("count")).first()[0]
    assert largest < 3 * 20000 / 16


def test_dense_codes_skip_null(spark):
    df = spark.createDataFrame([("B",), (None,), ("A",), ("C",), ("A",)], "t string")
    assert sorted(map(tuple, dense_codes(df, "t").collect())) == [("A", 1), ("B", 2), ("C", 3)]


def test_balanced_batches_many_classes_and_null_class(spark):
    df = spark.range(6000).select((F.col("id") % 2000).alias("c"), "id")
    df = df.unionByName(spark.range(6000, 6005).select(F.lit(None).cast("long").alias("c"), "id"))
    out = batching.balanced_batches(df, "c", ["id"], 2, seed=3)
    sizes = out.groupBy("batch", "c").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [2]
    assert out.groupBy("batch").count().select("count").distinct().first()[0] == 2 * 2001
    assert out.where("c is null").select("id").distinct().count() == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan.split("Scan")[0]


def test_small_class_cycles_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(batching, "SLOTS_PER_CHUNK", 7)
    df = spark.range(101).select(F.when(F.col("id") == 0, 1).otherwise(0).alias("c"), "id")
    out = batching.balanced_batches(df, "c", ["id"], 10, seed=1)
    assert out.where("c = 1").count() == 100
    assert out.where("c = 1").select("batch", "slot").distinct().count() == 100


def test_downsample_keeps_null_labels(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).alias("y"), "id")
    assert sampling.downsample_class(df, "y", ["id"], 0.1).where("y is null").count() == 500


def test_metrics_reject_bad_labels_and_null_scores(spark):
    rows = [(0, 0.1), (1, 0.9), (2, 0.5)]
    with pytest.raises(Exception, match="label must be 0 or 1"):
        metrics.roc_auc(spark.createDataFrame(rows, "label int, score double")).collect()
    with pytest.raises(Exception, match="score not NULL"):
        metrics.roc_auc(spark.createDataFrame([(0, None), (1, 0.5)], "label int, score double")).collect()
    grouped = spark.createDataFrame([(None, 0, 0.1), (None, 1, 0.9), (1, 0, 0.2), (1, 1, 0.1)],
                                    "g int, label int, score double")
    got = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(grouped, by=["g"]).collect()}
    assert got == {None: 1.0, 1: 0.0}


def test_strict_encoding_rejects_null(spark):
    codes = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sample_id int, codes array<int>")
    seqs = spark.createDataFrame([("ACDEFGHI", 1, 0.5), (None, 1, 0.5), ("ACDEFGHI", 1, None)],
                                 "seq string, sample_id int, abundance double")
    for bad in (seqs.where("seq is null"), seqs.where("abundance is null")):
        with pytest.raises(Exception, match="NULL"):
            encode_examples(bad, codes, "abundance").collect()
    good, rejects = encode_examples_checked(seqs, codes, "abundance")
    assert good.count() == 1
    assert [r["reason"] for r in rejects.collect()] == ["null_input"] * 2


def test_empty_slot_is_an_error_unless_allowed(spark):
    wide = spark.createDataFrame([(1, "x", None)], "sample_id int, A string, B string")
    vocab = spark.createDataFrame([("x", 4)], "term string, code int")
    with pytest.raises(Exception, match="empty slot"):
        encode_slots(wide, vocab).collect()
    assert encode_slots(wide, vocab, allow_empty=True).first()["codes"] == [4]


def test_path_columns_use_the_last_component(spark):
    paths = ["/data/hla_pos/train/train_sample_3_neg.txt", "/data/train/run1/test/test_sample_1_pos.txt",
             "file:///d/test/a%20b_pos.txt", "/d/split=train/file=s1_pos.txt/part-0.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in text.path_columns(F.col("p")).items()]).collect()]
    assert got == [("train", "train_sample_3", 0), ("test", "test_sample_1", 1), ("test", "a b", 1), ("train", "s1", 1)]


def test_line_numbers_across_splits(spark, scratch):
    root = scratch("numbered")
    spark.range(500).select(F.concat(F.lit("AC\t"), (F.col("id") % 2).cast("string")).alias("value")) \
        .coalesce(1).write.text(f"{root}/train/s1_pos.txt")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = text.read_labelled(spark, root, line_no=True)
        rows = got.select("line_no", "label").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["line_no"] for r in rows) == list(range(1, 501))
    assert all(r["label"] == (r["line_no"] - 1) % 2 for r in rows)


def test_wide_rows_are_not_broadcast_and_nothing_stays_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    wide = spark.range(400).select("id", F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert "ResolvedHint" not in sized_broadcast(wide)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in sized_broadcast(wide.limit(3))._jdf.queryExecution().analyzed().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_checkpoint_root_is_set(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
