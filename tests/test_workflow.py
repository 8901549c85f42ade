def test_end_to_end_demo(spark, scratch):
    from examples.end_to_end import run, write_demo_inputs

    work = scratch("workflow")
    vocab, slots, lines = write_demo_inputs(spark, "/root/testdata/sf0.001", f"{work}/inputs")
    history, report = run(spark, vocab, slots, lines, work, "abundance", n_per_class=50, steps=2)
    assert [h[0] for h in history] == [0, 1] and all(h[2] == 100 for h in history)
    rows = report.collect()
    assert {r["sample_id"] for r in rows} <= {f"sample_{i}" for i in range(5)}
    assert all(0.0 <= r["roc_auc"] <= 1.0 for r in rows)
