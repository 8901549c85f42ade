"""Growing vocabularies and example tables in buckets."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epiframe.operators.vocabulary import add_version, changed_codes, vocabulary_at
from epiframe.sources import bucketed, sinks, text


def _terms(spark, values):
    return spark.createDataFrame([(v,) for v in values], "term string")


def _codes(df):
    return {r["term"]: r["code"] for r in df.collect()}


def test_old_terms_keep_their_codes(spark, scratch):
    path = scratch("versions")
    one = _codes(add_version(spark, path, 1, _terms(spark, ["m", "c", "c", None, "", " "])))
    assert one == {"c": 1, "m": 2}
    two = _codes(add_version(spark, path, 2, _terms(spark, ["a", "m", "z", "a"])))
    assert two == {"c": 1, "m": 2, "a": 3, "z": 4}
    # a version without new terms, and one after it
    assert _codes(add_version(spark, path, 3, _terms(spark, ["a", None]))) == two
    four = _codes(add_version(spark, path, 4, _terms(spark, ["b"])))
    assert four == {**two, "b": 5}
    assert _codes(vocabulary_at(spark, path, 1)) == one
    assert changed_codes(vocabulary_at(spark, path, 1), vocabulary_at(spark, path, 4)).count() == 0


def test_a_lost_writer_runs_again_with_the_same_codes(spark, scratch):
    path = scratch("versions")
    add_version(spark, path, 1, _terms(spark, ["x"]))
    first = _codes(add_version(spark, path, 2, _terms(spark, ["b", "a", "x"])))
    assert _codes(add_version(spark, path, 2, _terms(spark, ["x", "a", "b", "b"]))) == first


def test_versions_follow_one_another(spark, scratch):
    path = scratch("versions")
    add_version(spark, path, 1, _terms(spark, ["x"]))
    with pytest.raises(ValueError, match="without version 2"):
        add_version(spark, path, 3, _terms(spark, ["y"]))
    add_version(spark, path, 2, _terms(spark, ["y"]))
    with pytest.raises(ValueError, match="built on"):
        add_version(spark, path, 1, _terms(spark, ["w"]))
    with pytest.raises(ValueError, match="count from 1"):
        add_version(spark, path, 0, _terms(spark, ["w"]))


def test_an_empty_vocabulary_grows(spark, scratch):
    path = scratch("versions")
    assert _codes(add_version(spark, path, 1, _terms(spark, []))) == {}
    assert _codes(add_version(spark, path, 2, _terms(spark, ["q"]))) == {"q": 1}


def test_ordered_lines_are_numbered_across_files(spark, scratch):
    path = scratch("lines")
    n = 500
    df = spark.range(n).select(F.concat(F.lit("t"), "id").alias("value"), (F.lit(n) - F.col("id")).alias("rank"))
    sinks.write_ordered_lines(df, path, ["rank"], n_files=4)
    got = _codes(text.read_vocab(spark, path))
    assert got == {f"t{i}": n - i for i in range(n)}


# --- buckets ----------------------------------------------------------------------

def _examples(spark, n=3000):
    """One sample holds half of the rows, one is NULL."""
    sample = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 31 == 1, None).otherwise(F.col("id") % 5)
    return spark.range(n).select(sample.cast("bigint").alias("sample_id"), F.xxhash64("id").alias("key"), "id")


def _table():
    return "bucket_test_" + uuid.uuid4().hex[:10]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_numbering_in_buckets_equals_a_plain_order(spark, scratch, no_broadcast):
    name, df = _table(), _examples(spark)
    bucketed.write_bucketed(df, name, scratch("bucketed"), "sample_id", ["key"], 4)
    out = bucketed.number_bucketed(spark, name, "sample_id", ["key"], 100)
    assert "Exchange" not in _plan(out)
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["key"]):
        want.setdefault(r["sample_id"], []).append(r["id"])
    got = out.collect()
    assert len(got) == 3000 and out.columns == ["sample_id", "key", "id", "rn", "batch"]
    for r in got:
        assert want[r["sample_id"]][r["rn"] - 1] == r["id"] and r["batch"] == (r["rn"] - 1) // 100
    # the hot sample is in many spans
    assert spark.table(f"{name}_spans").where("sample_id = 7").count() > 4


def test_codes_join_in_buckets_without_exchange(spark, scratch, no_broadcast):
    name, df = _table(), _examples(spark).where("sample_id is not null")
    bucketed.write_bucketed(df, name, scratch("bucketed"), "sample_id", ["key"], 4)
    dim = spark.createDataFrame([(i, [i, i + 1]) for i in range(8)], "sample_id bigint, codes array<int>")
    bucketed.write_bucketed_dimension(spark, dim, name, f"{name}_codes", scratch("dim"), "sample_id")
    out = bucketed.attach_bucketed(spark, name, f"{name}_codes", "sample_id", "codes")
    assert "Exchange" not in _plan(out)
    assert {(r["id"], r["sample_id"], tuple(r["codes"])) for r in out.collect()} == \
        {(r["id"], r["sample_id"], (r["sample_id"], r["sample_id"] + 1)) for r in df.collect()}


def test_a_sample_without_codes(spark, scratch):
    name, df = _table(), _examples(spark, 300)
    bucketed.write_bucketed(df, name, scratch("bucketed"), "sample_id", ["key"], 2)
    dim = spark.createDataFrame([(7, [1])], "sample_id bigint, codes array<int>")
    bucketed.write_bucketed_dimension(spark, dim, name, f"{name}_codes", scratch("dim"), "sample_id")
    assert bucketed.attach_bucketed(spark, name, f"{name}_codes", "sample_id", "codes", strict=False).count() == 150
    with pytest.raises(PySparkException, match="no codes for sample"):
        bucketed.attach_bucketed(spark, name, f"{name}_codes", "sample_id", "codes").collect()


def test_another_session_registers_a_stored_table(spark, scratch, no_broadcast):
    name, again, path = _table(), _table(), scratch("bucketed")
    df = _examples(spark, 400)
    bucketed.write_bucketed(df, name, path, "sample_id", ["key"], 4)
    bucketed.register_bucketed(spark, again, path)
    bucketed.register_bucketed(spark, f"{again}_spans", f"{path}.spans")
    assert bucketed.bucket_count(spark, again) == 4
    one, two = (bucketed.number_bucketed(spark, t, "sample_id", ["key"], 10) for t in (name, again))
    assert "Exchange" not in _plan(two)
    assert sorted(one.collect(), key=lambda r: r["id"]) == sorted(two.collect(), key=lambda r: r["id"])


def test_empty_tables_and_taken_names(spark, scratch):
    name = _table()
    bucketed.write_bucketed(_examples(spark, 0), name, scratch("bucketed"), "sample_id", ["key"], 2)
    assert bucketed.number_bucketed(spark, name, "sample_id", ["key"], 10).count() == 0
    with pytest.raises(ValueError, match="span"):
        bucketed.write_bucketed(_examples(spark, 3).withColumn("span", F.lit(1)), _table(), scratch("b"), "sample_id", ["key"], 2)
