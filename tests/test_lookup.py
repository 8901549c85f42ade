import pytest

from epiframe.operators.examples import encode_examples
from epiframe.operators.lookup import (attach_sample_codes, encode_slots, unmatched_samples,
                                       unmatched_terms, unpivot_slots)


@pytest.fixture()
def vocab(spark):
    return spark.createDataFrame([("A*01", 1), ("A*02", 2), ("B*07", 3), ("C*01", 4)],
                                 "term string, code int")


def test_encode_slots_sorted_with_duplicates(spark, vocab):
    wide = spark.createDataFrame([("s1", "B*07", "A*02", "C*01", "C*01", "A*01", "A*01")],
                                 "sample_id string, A1 string, A2 string, B1 string, "
                                 "B2 string, C1 string, C2 string")
    got = encode_slots(wide, vocab).first()
    assert got["codes"] == [1, 1, 2, 3, 4, 4]     # homozygous slots count twice


def test_unknown_term_and_repeated_sample(spark, vocab):
    wide = spark.createDataFrame([("s1", "A*01", "X*99")], "sample_id string, A1 string, A2 string")
    with pytest.raises(Exception, match="unknown allele term"):
        encode_slots(wide, vocab).collect()
    assert encode_slots(wide, vocab, strict=False).first()["codes"] == [1]
    bad = unmatched_terms(unpivot_slots(wide), vocab).collect()
    assert [(r["sample_id"], r["term"]) for r in bad] == [("s1", "X*99")]
    dup = spark.createDataFrame([("s1", "A*01"), ("s1", "A*02")], "sample_id string, A1 string")
    with pytest.raises(Exception, match="more than once"):
        encode_slots(dup, vocab).collect()
    # two partial rows for one id: still a repeated sample
    dup2 = spark.createDataFrame([("s1", "A*01", None), ("s1", "A*02", None)],
                                 "sample_id string, A1 string, A2 string")
    with pytest.raises(Exception, match="more than once"):
        encode_slots(dup2, vocab, allow_empty=True).collect()


def test_attach_codes_strict_and_broadcast(spark):
    codes = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sample_id long, codes array<int>")
    ex = spark.createDataFrame([("ACDEFGHI", 1, 1), ("ACDEFGHI", 2, 0)],
                               "seq string, sample_id long, label int")
    with pytest.raises(Exception, match="no allele codes"):
        attach_sample_codes(ex, codes).collect()
    ok = attach_sample_codes(ex, codes, strict=False)
    assert ok.count() == 1
    assert unmatched_samples(ex, codes).first()["sample_id"] == 2
    plan = ok._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_encode_examples_variants(spark):
    codes = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sample_id long, codes array<int>")
    ex = spark.createDataFrame([("ACDEFGHI", 1, 1, 2.5, "ACDEFGHIKL")],
                               "seq string, sample_id long, label int, abundance double, flank string")
    v17 = encode_examples(ex, codes, "base").first()["vec"]
    v18 = encode_examples(ex, codes, "abundance").first()["vec"]
    v28 = encode_examples(ex, codes, "flank").first()["vec"]
    assert len(v17) == 17 and v17[11:] == [1, 2, 3, 4, 5, 6]
    assert len(v18) == 18 and v18[17] == 2.5
    assert len(v28) == 28 and v28[18:] == [float(x) for x in range(1, 11)]


def test_reject_mode_reasons(spark):
    from epiframe.operators.examples import encode_examples_checked

    codes = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sample_id long, codes array<int>")
    ex = spark.createDataFrame([("ACDEFGHI", 1), ("ACDXFGHI", 1), ("ACDEFGHIKLMN", 1),
                                ("ACDEFGHI", 9)], "seq string, sample_id long")
    good, bad = encode_examples_checked(ex, codes)
    assert [len(r["vec"]) for r in good.collect()] == [17]
    reasons = sorted((r["seq"], r["reason"]) for r in bad.collect())
    assert reasons == [("ACDEFGHI", "unknown_sample"), ("ACDEFGHIKLMN", "bad_width"),
                       ("ACDXFGHI", "unknown_letter")]


def test_broadcast_bound_counts_bytes(spark):
    from epiframe.plans.joins import max_broadcast_rows

    narrow = spark.createDataFrame([(1, 2)], "a int, b int")
    wide = spark.createDataFrame([(1, [1.0] * 3, "x")], "a int, v array<double>, s string")
    assert max_broadcast_rows(narrow) == 1_000_000
    assert max_broadcast_rows(wide) < max_broadcast_rows(narrow)
    spark.conf.set("epiframe.broadcast.maxBytes", "1000")
    try:
        assert max_broadcast_rows(wide) < 10
    finally:
        spark.conf.unset("epiframe.broadcast.maxBytes")


def test_lax_encoding_nulls_bad_rows(spark):
    codes = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sample_id long, codes array<int>")
    ex = spark.createDataFrame([("ACDEFGHI", 1), ("ACDXFGHI", 1), ("ACDEFGHIKLMN", 1),
                                ("ACDEFGHI", 9)], "seq string, sample_id long")
    out = {r["seq"]: r["vec"] for r in encode_examples(ex, codes, strict=False).collect()}
    assert len(out) == 3 and len(out["ACDEFGHI"]) == 17
    assert out["ACDXFGHI"] is None and out["ACDEFGHIKLMN"] is None


def test_reject_mode_flank(spark):
    from epiframe.operators.examples import encode_examples_checked

    codes = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6])], "sample_id long, codes array<int>")
    ex = spark.createDataFrame([("ACDEFGHI", 1, 0.5, "ACDEFGHIKL"), ("ACDEFGHI", 1, 0.5, "ACDEFGHIKX"),
                                ("ACDEFGHI", 1, 0.5, "ACDEF")],
                               "seq string, sample_id long, abundance double, flank string")
    good, bad = encode_examples_checked(ex, codes, "flank")
    assert [len(r["vec"]) for r in good.collect()] == [28]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_width", "unknown_letter"]
