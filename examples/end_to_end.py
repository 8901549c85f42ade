"""The whole workflow on files, as a user of the reference runs it.

    python examples/end_to_end.py --vocab V --slots S --lines L --work W
    python examples/end_to_end.py --demo /root/testdata/sf0.001 --work W

Inputs: a headerless allele vocabulary (one term per line), a headered typing
CSV (sample id, six allele slots), and unsplit labelled lines
``<L>/<split>/<sample>.txt`` whose last tab field is the label
(``seq<TAB>abundance<TAB>label``). Steps:

1. dictionaries: vocabulary + typing -> per-sample codes (saved as Parquet)
2. split by label and down-sample negatives, one scan (written as text)
3. encode every line to an example vector, write Parquet by split/sample/label
4. balanced batches of the training split, a few data-parallel Adam steps
5. score the held-out split, ROC-AUC / PR-AUC / log loss per sample
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from epiframe.operators import batching, metrics, scoring, split  # noqa: E402
from epiframe.operators.examples import encode_examples  # noqa: E402
from epiframe.operators.lookup import encode_slots  # noqa: E402
from epiframe.session import build_session, scratch_path  # noqa: E402
from epiframe.sources import dataset, sinks, text  # noqa: E402


def write_demo_inputs(spark, sf_dir: str, root: str) -> tuple[str, str, str]:
    """Build the three inputs from the driver's tables (stand-ins)."""
    from epiframe import standins as S

    voc, slots, lines = f"{root}/vocab", f"{root}/slots", f"{root}/lines"
    sinks.write_merged(S.voc_table(spark, sf_dir).select(F.col("term").alias("value"), "code"),
                       voc, order=["code"])
    S.slots_wide(spark, sf_dir).withColumn("sample_id", F.concat(
        F.lit("sample_"), F.col("sample_id").cast("string"))).write.option("header", "true").csv(slots)
    seq = S.seq_table(spark, sf_dir)
    out = seq.select(
        F.concat_ws("\t", "seq", F.col("abundance").cast("string"), F.col("label").cast("string"))
        .alias("value"),
        F.when(F.col("sample_id") < 5, "test").otherwise("train").alias("split"),
        F.concat(F.lit("sample_"), F.col("sample_id").cast("string"), F.lit(".txt")).alias("file"))
    sinks.write_lines(out, lines, partition_by=["split", "file"])
    return voc, slots, lines


def run(spark, vocab: str, slots: str, lines: str, work: str, variant: str = "abundance",
        fraction: float = 0.1, n_per_class: int = 200, steps: int = 3, seed: int = 0):
    # 1. dictionaries
    codes = encode_slots(text.read_slots(spark, slots), text.read_vocab(spark, vocab), allow_empty=True)
    sinks.save_dictionaries(sinks.residue_table(spark), codes, f"{work}/dict")
    _, codes = sinks.load_dictionaries(spark, f"{work}/dict")

    # 2. split + down-sample negatives in one scan; keyed by (file, line number) so the
    #    same lines are kept on any re-run and equal lines are decided one by one
    raw = text.with_path_columns(text.numbered_lines(spark, lines), "file")
    raw = raw.select("value", "split", "sample", "file", "line_no")
    split.write_split(raw, f"{work}/split", extra_partitions=("split", "sample"),
                      negative_fraction=fraction, key_cols=("file", "line_no"), seed=seed)

    # 3. encode and write examples
    # directories give split and sample; the label is parsed from the line itself
    split_lines = spark.read.text(f"{work}/split").drop("label")
    parsed = text.parse_fields(text.clean_lines(split_lines), fields=3)
    parsed = parsed.withColumnRenamed("sample", "sample_id")
    ex = encode_examples(parsed, codes, variant)
    sinks.write_examples(ex.select("seq", "vec", "split", "sample_id", "label"), f"{work}/examples")

    # 4. fit on balanced batches of the training split
    cfg = scoring.ScorerConfig(variant)
    pos, neg = dataset.read_class_sets(spark, f"{work}/examples", "train")
    train = pos.unionByName(neg)
    b = batching.balanced_batches(train, "label", ["sample_id", "seq"], n_per_class, seed=seed)
    weights, history = scoring.fit_scorer(b, cfg, steps=steps, lr=1e-2, seed=seed,
                                          keys=["sample_id", "seq", "slot"], batch_col="batch",
                                          save_path=f"{work}/fit")

    # 5. evaluate each held-out sample
    held = dataset.read_examples(spark, f"{work}/examples").filter(F.col("split") == "test")
    scored = scoring.score_examples(held, weights, cfg)
    report = metrics.evaluate_by_sample(scored)
    return history, report


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--vocab")
    ap.add_argument("--slots")
    ap.add_argument("--lines")
    ap.add_argument("--demo", help="build inputs from the driver tables at this sf dir")
    ap.add_argument("--work", default=None)
    ap.add_argument("--variant", default="abundance")
    ap.add_argument("--steps", type=int, default=3)
    a = ap.parse_args()
    spark = build_session()
    work = a.work or scratch_path(spark, "workflow")
    if a.demo:
        vocab, slots, lines = write_demo_inputs(spark, a.demo, f"{work}/inputs")
    else:
        vocab, slots, lines = a.vocab, a.slots, a.lines
    history, report = run(spark, vocab, slots, lines, work, a.variant, steps=a.steps)
    for step, loss, rows in history:
        print(f"step {step}: loss {loss:.4f} on {rows} rows")
    report.orderBy("sample_id").show(truncate=False)


if __name__ == "__main__":
    main()
