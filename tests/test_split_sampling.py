import pytest
from pyspark.sql import functions as F

from epiframe.operators import sampling, split


def test_split_by_last_field(spark):
    df = spark.createDataFrame([("A\t0.5\t1",), ("B\t0",), ("C\t2",), ("D\t 1 ",)], "value string")
    assert sorted(r["value"] for r in split.positives(df).collect()) == ["A\t0.5\t1", "D\t 1 "]
    assert [r["value"] for r in split.negatives(df).collect()] == ["B\t0"]
    assert [r["value"] for r in split.dropped_lines(df).collect()] == ["C\t2"]


@pytest.mark.parametrize("line", ["", "A\t1.0", "A\t1\t"])
def test_split_bad_label_raises(spark, line):
    df = spark.createDataFrame([(line,)], "value string")
    with pytest.raises(Exception):
        split.split_by_label(df).collect()


def test_hash_sample_is_layout_stable(spark):
    df = spark.range(0, 20000).withColumn("k2", F.col("id") % 7)
    a = sampling.sample_by_key(df, ["id", "k2"], 0.1, seed=3)
    b = sampling.sample_by_key(df.repartition(13), ["id", "k2"], 0.1, seed=3)
    ra = sorted(r["id"] for r in a.collect())
    assert ra == sorted(r["id"] for r in b.collect())
    assert 1700 < len(ra) < 2300


def test_downsample_keeps_other_class_whole(spark):
    df = spark.range(0, 10000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    out = sampling.downsample_class(df, "label", ["id"], 0.1, seed=1)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[1] == 2500 and 600 < counts[0] < 900
    bern = sampling.downsample_class_bernoulli(df, "label", 0.1, seed=1)
    assert bern.filter("label = 1").count() == 2500


def test_write_split_one_scan_with_downsampling(spark, scratch):
    from epiframe.sources.text import scan_lines

    lines = spark.range(0, 4000).select(
        F.concat_ws("\t", F.col("id").cast("string"), (F.col("id") % 4 == 0).cast("int").cast("string"))
        .alias("value"))
    path = scratch("split")
    split.write_split(lines, path, negative_fraction=0.1, key_cols=("value",), seed=5)
    back = scan_lines(spark, path, recursive=False)      # partition column label comes back
    counts = {r["label"]: r["count"] for r in back.groupBy("label").count().collect()}
    assert counts[1] == 1000 and 200 < counts[0] < 400


def test_label_checks_do_not_depend_on_ansi(spark):
    from epiframe.sources.text import parse_fields

    df = spark.createDataFrame([("A\t1.0",)], "value string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="not an integer"):
            split.split_by_label(df).collect()
        with pytest.raises(Exception, match="not a valid int"):
            parse_fields(df, 2).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
