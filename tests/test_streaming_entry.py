import os

from epiframe.session import local_path


def test_encode_stream_matches_batch(spark, scratch):
    from epiframe.streaming import start_encode_stream

    root = scratch("stream-in")
    for name, body in [("train/s1_pos.txt", "ACDEFGHI\t1\nACDEFGHIK\t1\n"),
                       ("train/s1_neg.txt", "ACDEFGHIKL\t0\n")]:
        p = os.path.join(local_path(root), name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(body)
    codes = spark.createDataFrame([("s1", [1, 2, 3, 4, 5, 6])], "sample_id string, codes array<int>")
    out, ck = scratch("stream-out"), scratch("stream-ck")
    q = start_encode_stream(spark, root, codes, out, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    rows = sorted((r["seq"], r["label"], len(r["vec"])) for r in got.collect())
    assert rows == [("ACDEFGHI", 1, 17), ("ACDEFGHIK", 1, 17), ("ACDEFGHIKL", 0, 17)]


def test_registry_contract():
    import __spark_entry__ as E
    from epiframe.registry import QUERIES

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(QUERIES) <= set(qs)
    # only the non-deterministic sampler and the fit lack a SQL twin
    assert set(QUERIES) - set(sql) == {"sample_bernoulli", "fit_scorer"}
    # the rest comes from the optional subpackage
    for name in set(qs) - set(QUERIES):
        assert name.startswith("op") or name == "pipeline"


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["doc_id", "pos", "sample_id", "label", "vec"]
    assert df.count() > 0


def test_encode_stream_restart_skips_done_files(spark, scratch):
    from epiframe.streaming import start_encode_stream

    root = scratch("stream-in2")
    codes = spark.createDataFrame([("s1", [1, 2, 3, 4, 5, 6])], "sample_id string, codes array<int>")
    out, ck = scratch("stream-out2"), scratch("stream-ck2")

    def add(name, body):
        p = os.path.join(local_path(root), name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(body)

    add("train/s1_pos.txt", "ACDEFGHI\t1\n")
    start_encode_stream(spark, root, codes, out, ck).awaitTermination(120)
    add("train/s1_neg.txt", "ACDEFGHIK\t0\n")
    start_encode_stream(spark, root, codes, out, ck).awaitTermination(120)
    rows = sorted((r["seq"], r["label"]) for r in spark.read.parquet(out).collect())
    assert rows == [("ACDEFGHI", 1), ("ACDEFGHIK", 0)]      # first file not encoded twice


def test_python_tasks_work_from_another_directory(tmp_path):
    """Executors import the package through the archive shipped with addPyFile,
    not through the driver's working directory."""
    import subprocess
    import sys
    import textwrap

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        from epiframe.operators import scoring
        spark = (SparkSession.builder.master("local[2]")
                 .config("spark.ui.enabled", "false").getOrCreate())
        cfg = scoring.ScorerConfig("base", hidden=4, categories=30)
        df = spark.createDataFrame([(1, [1.0] * 17, 1)], "id int, vec array<double>, label int")
        print("SCORE", scoring.score_examples(df, scoring.rule_weights(cfg), cfg).first()["score"])
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert "SCORE" in out.stdout, out.stderr[-2000:]
