import os

import pytest

from epiframe.session import local_path
from epiframe.sources import dataset, sinks, text


def _write(path, name, content):
    p = os.path.join(local_path(path), name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", newline="") as f:
        f.write(content)
    return p


def test_read_vocab_blank_and_repeated(spark, scratch):
    d = scratch("voc")
    _write(d, "v.csv", "A*01\n\nB*07\r\n A*01 \nC*01\n")
    got = {r["term"]: r["code"] for r in text.read_vocab(spark, d).collect()}
    # a blank line uses up code 2; a repeated term keeps its last number
    assert got == {"A*01": 4, "B*07": 3, "C*01": 5}
    d2 = scratch("voc-cr")
    _write(d2, "v.csv", "A*01\rB*07\r\rC*01\r")
    got2 = {r["term"]: r["code"] for r in text.read_vocab(spark, d2).collect()}
    assert got2 == {"A*01": 1, "B*07": 2, "C*01": 4}


def test_read_vocab_over_many_splits(spark, scratch):
    d = scratch("voc-big")
    terms = [f"T{i:05d}" if i % 7 else "" for i in range(1, 2001)]
    _write(d, "v.csv", "\n".join(terms) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        blocks = spark.read.text(d).select("_metadata.file_block_start").distinct().count()
        df = text.read_vocab(spark, d)
        got = {r["term"]: r["code"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {t: i + 1 for i, t in enumerate(terms) if t}
    assert blocks > 5
    assert got == want


def test_dense_codes_match_sorted_order(spark):
    from epiframe.plans.ordering import dense_codes

    words = ["beta", "Alpha", "alpha", "", "ü", "b", "beta", "zz", "a\u00e9", "ab"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r["t"]: r["code"] for r in dense_codes(df, "t", n_buckets=4).collect()}
    uniq = sorted(set(words), key=lambda x: x.encode("utf-8"))
    assert got == {w: i + 1 for i, w in enumerate(uniq)}


def test_read_slots_header(spark, scratch):
    d = scratch("slots")
    _write(d, "s.csv", "paper_sampe_id,A1,A2\ntrain_sample_1,A*01,A*02\n")
    df = text.read_slots(spark, d)
    assert df.columns == ["sample_id", "A1", "A2"]
    assert df.first()["A2"] == "A*02"


def test_read_labelled_and_paths(spark, scratch):
    root = scratch("lines")
    _write(root, "train/train_sample_3_pos.txt", "ACDEFGHI\t1\r\n\n  ACDEFGHIK\t1 \n\t\n")
    _write(root, "train/train_sample_3_neg.txt", "ACDEFGHIKL\t0\n")
    _write(root, "test/test_sample_0_pos.txt", "ACDEFGHIKL\t0.5\t1\n")
    two = text.read_labelled(spark, f"{root}/train", fields=2)
    rows = sorted((r["seq"], r["label"], r["sample"], r["split"], r["path_label"])
                  for r in two.collect())
    assert rows == [("ACDEFGHI", 1, "train_sample_3", "train", 1),
                    ("ACDEFGHIK", 1, "train_sample_3", "train", 1),
                    ("ACDEFGHIKL", 0, "train_sample_3", "train", 0)]
    three = text.read_labelled(spark, f"{root}/test", fields=3).first()
    assert (three["seq"], three["abundance"], three["label"]) == ("ACDEFGHIKL", 0.5, 1)


def test_path_rules(spark):
    df = spark.createDataFrame([("/d/train/train_sample_3_pos.txt",),
                                ("/d/test_sample_1.txt",),
                                ("/x/split=test/file=sample_2_neg.txt/part-0.txt",),
                                ("/x/split=train/file=sample_4.txt/part-00001-abc.txt",)], "p string")
    got = [tuple(r[1:]) for r in text.with_path_columns(df, "p").collect()]
    assert got == [("train", "train_sample_3", 1), (None, "test_sample_1", None),
                   ("test", "sample_2", 0), ("train", "sample_4", None)]


def test_bad_label_raises(spark):
    df = spark.createDataFrame([("ACD\t1.0",)], "value string")
    with pytest.raises(Exception):
        text.parse_fields(df, 2).collect()
    assert text.parse_fields(df, 2, strict=False).first()["label"] is None


def test_examples_roundtrip_and_pruning(spark, scratch):
    root = scratch("ex")
    df = spark.createDataFrame([(1, 0, [1, 2], "train", 3, 1), (2, 0, [3, 4], "test", 0, 0)],
                               "doc_id long, pos int, vec array<int>, split string, "
                               "sample_id long, label int")
    sinks.write_examples(df, root)
    pos, neg = dataset.read_class_sets(spark, root, "train")
    assert pos.count() == 1 and neg.count() == 0
    plan = pos._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partitionFilters" in plan.lower()
    held = dataset.read_sample(spark, root, [0])
    assert [r["doc_id"] for r in held.collect()] == [2]
    samples = spark.createDataFrame([("train", "3"), ("test", "0")], "split string, sample string")
    man = dataset.dataset_manifest(samples, id_col="sample")
    rep = {(r["split"], r["cls"]): (r["present"], r["missing"])
           for r in dataset.check_examples(spark, root, man).collect()}
    assert rep == {("train", "pos"): (1, 0), ("train", "neg"): (0, 1),
                   ("test", "pos"): (0, 1), ("test", "neg"): (1, 0)}


def test_manifest_and_check(spark):
    samples = spark.createDataFrame([("train", "a"), ("test", "b")], "split string, sample string")
    man = dataset.dataset_manifest(samples, id_col="sample")
    assert man.count() == 4
    present = spark.createDataFrame([("train", "a_pos"), ("train", "a_neg"), ("test", "b_pos")],
                                    "split string, file string")
    rep = {(r["split"], r["cls"]): r["missing"] for r in dataset.check_complete(man, present).collect()}
    assert rep[("test", "neg")] == 1 and rep[("train", "pos")] == 0
    with pytest.raises(AssertionError):
        dataset.assert_complete(dataset.check_complete(man, present))


def test_dictionaries_roundtrip(spark, scratch):
    path = scratch("dict")
    codes = spark.createDataFrame([(1, [1, 2])], "sample_id long, codes array<int>")
    sinks.save_dictionaries(sinks.residue_table(spark), codes, path)
    res, samp = sinks.load_dictionaries(spark, path)
    assert sinks.residue_codes_from(res)["Z"] == 0 and samp.first()["codes"] == [1, 2]
    assert res.count() == 23


def test_write_merged_single_ordered_file(spark, scratch):
    path = scratch("merged")
    df = spark.range(0, 500).selectExpr("cast(id as string) value", "id").repartition(7)
    sinks.write_merged(df, path, order=["id"])
    files = [f for f in os.listdir(local_path(path)) if f.startswith("part-")]
    assert len(files) == 1
    with open(os.path.join(local_path(path), files[0])) as f:
        assert [int(x) for x in f.read().split()] == list(range(500))


def test_scan_lines_min_partitions(spark, scratch):
    d = scratch("scan")
    _write(d, "a.txt", "".join(f"L{i}\n" for i in range(100)))
    assert text.scan_lines(spark, d, min_partitions=6).rdd.getNumPartitions() >= 6
    assert text.scan_lines(spark, d).count() == 100


def test_encode_with_saved_residue_table(spark, scratch):
    from epiframe.functions import encode_letters

    path = scratch("dict2")
    codes = spark.createDataFrame([(1, [1])], "sample_id long, codes array<int>")
    sinks.save_dictionaries(sinks.residue_table(spark), codes, path)
    res, _ = sinks.load_dictionaries(spark, path)
    table = sinks.residue_codes_from(res)
    df = spark.createDataFrame([("ACZOU",)], "s string")
    assert df.select(encode_letters("s", table)).first()[0] == [1, 2, 0, 21, 22]
