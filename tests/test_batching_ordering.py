from pyspark.sql import Window
from pyspark.sql import functions as F

from epiframe.operators import batching
from epiframe.plans.ordering import ordered_index, positive_hash, hash_bucket


def test_two_level_index_equals_single_window(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 3).cast("int"))
    h = positive_hash(["id"], 5)
    staged = df.withColumn("h", h)
    got = ordered_index(staged, [F.col("h"), F.col("id")], hash_bucket(F.col("h"), 16), by=["g"])
    ref = staged.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    j = got.join(ref.select("id", "rn_ref"), "id")
    assert j.filter(F.col("rn") != F.col("rn_ref")).count() == 0


def test_balanced_batches_exact_per_class(spark):
    df = spark.range(0, 2300).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    out = batching.balanced_batches(df, "label", ["id"], 100, seed=2)
    per = out.groupBy("batch", "label").count()
    assert set(r["count"] for r in per.collect()) == {100}
    assert out.select("batch").distinct().count() == 21        # ceil(2070 / 100)
    # every row of the larger class appears, the smaller class is cycled
    assert out.filter("label = 0").select("id").distinct().count() == 2070
    assert out.filter("label = 1").select("id").distinct().count() == 230
    again = batching.balanced_batches(df.repartition(7), "label", ["id"], 100, seed=2)
    key = ["batch", "slot", "label", "id"]
    assert out.select(*key).exceptAll(again.select(*key)).count() == 0


def test_sequential_batches(spark):
    df = spark.range(0, 1000).withColumn("label", (F.col("id") % 2).cast("int")) \
        .withColumn("grp", (F.col("id") % 3).cast("int"))
    out = batching.sequential_batches(df, 50, order=["id"], split_col="id", lead=["label"],
                                      by=["grp"])
    ref = df.withColumn("rn_ref", F.row_number().over(
        Window.partitionBy("grp").orderBy("label", "id")))
    j = out.join(ref.select("id", "rn_ref"), "id")
    assert j.filter(F.col("rn") != F.col("rn_ref")).count() == 0
    assert out.filter("batch = (rn - 1) div 50").count() == 1000


def test_running_totals_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from epiframe.plans.ordering import quantile_bucket, running_totals

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50), st.integers(0, 9)),
                    min_size=1, max_size=120),
           st.sampled_from([1, 2, 8, 64]))
    def check(rows, n_buckets):
        data = [(i, g, k, w) for i, (g, k, w) in enumerate(rows)]
        df = spark.createDataFrame(data, "id int, g int, k int, w int")
        staged = quantile_bucket(df, "k", n_buckets)
        got = running_totals(staged, ["g"], "_bkt", [F.col("k"), F.col("id")],
                             {"cw": F.col("w").cast("bigint")})
        res = {r["id"]: r["cw"] for r in got.collect()}
        for i, g, k, w in data:
            ref = sum(w2 for j, g2, k2, w2 in data if g2 == g and (k2, j) <= (k, i))
            assert res[i] == ref

    check()
