"""Registered queries (one per operator of the inventory) and their DuckDB twins.

Every query reads the driver's tables (or data Spark derives from them) whole.
Array results are returned as comma-joined strings and floating results are
rounded to 6 digits so that two engines can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe import standins as S
from epiframe.functions.activations import relu, sigmoid
from epiframe.functions.linear import affine
from epiframe.functions.encode import (encode_letters, multi_hot, one_hot, pad_middle,
                                       peptide_vector, slice_features)
from epiframe.operators import batching, curves, epochs, exact_sampling, metrics, observed, sampling, scoring, split, vocabulary
from epiframe.operators.examples import encode_examples, encode_examples_checked
from epiframe.operators.lookup import (attach_sample_codes, encode_slots, unmatched_terms,
                                       unpivot_slots)
from epiframe.session import scratch_path, stored
from epiframe.sources import bucketed, dataset, sinks, text

Query = Callable[[SparkSession, str], DataFrame]

N_TEST_SAMPLES = 5          # samples 0..4 are held out, as the reference holds out five
BATCH_PER_CLASS = 1000
SEQUENTIAL_ROWS = 300
EXAMPLE_BUCKETS = 8          # buckets of the stored example tables
VOCAB_FILES = 3             # files of the vocabulary that read_vocab numbers
SEED = 7
FRACTION = 0.1
KNOWN_BELOW = "Brand#4"     # terms below this are in the dictionary of the look-up report
EXACT_FRACTION = (1, 10)    # numerator, denominator
SMALL_HIDDEN = 8            # hidden units where every gradient component is compared
FIT_RATE = 0.01
OFF_KINK = {"b1": 0.003, "f1": 0.003, "a1": 0.00003}
MASK_UNITS, MASK_STEPS, KEEP = 6, (0, 1, 7), 0.75
FIRST_EPOCH, LAST_EPOCH = 1, 3
N_EXPECTED, NOT_EXPECTED = 36, (30, 31)
SCORE_LOW, SCORE_HIGH, SCORE_BINS = 8.0, 23.0, 6


def arr_str(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(",", c.cast("array<string>"))


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0


def _codes(spark, sf):
    # derived dimensions are written once: measuring them for a broadcast and joining
    # them read the result, not the derivation
    voc = stored(S.voc_table(spark, sf), "vocabulary")
    return stored(encode_slots(S.slots_wide(spark, sf), voc, allow_empty=True), "sample-codes")


def _split_col() -> Column:
    return F.when(F.col("sample_id") < N_TEST_SAMPLES, "test").otherwise("train")


SPLIT_SQL = f"case when sample_id < {N_TEST_SAMPLES} then 'test' else 'train' end"


# ------------------------------------------------------------------ encoding

def q_encode_letters(spark, sf):
    s = S.seq_table(spark, sf)
    return s.select("doc_id", "pos", arr_str(encode_letters("seq")).alias("codes"))


def q_pad_middle(spark, sf):
    s = S.seq_table(spark, sf)
    return s.select("doc_id", "pos", arr_str(pad_middle(encode_letters("seq"))).alias("vec"))


def q_encode_slots(spark, sf):
    return _codes(spark, sf).select("sample_id", arr_str("codes").alias("codes"))


def q_assemble17(spark, sf):
    ex = encode_examples(S.seq_table(spark, sf), _codes(spark, sf), "base")
    return ex.select("doc_id", "pos", "sample_id", "label", arr_str("vec").alias("vec"))


def q_assemble18(spark, sf):
    ex = encode_examples(S.seq_table(spark, sf), _codes(spark, sf), "abundance")
    return ex.select("doc_id", "pos", "sample_id", "label", arr_str("vec").alias("vec"))


def q_assemble28(spark, sf):
    ex = encode_examples(S.seq_flank_table(spark, sf), _codes(spark, sf), "flank")
    return ex.select("doc_id", "pos", "sample_id", "label", arr_str("vec").alias("vec"))


def q_one_hot(spark, sf):
    # the peptide vector is its own column, so the 11 per-position references of
    # the one-hot read it instead of re-encoding the sequence each time
    s = S.seq_table(spark, sf).select("doc_id", "pos", peptide_vector("seq").alias("pv"))
    return s.select("doc_id", "pos", arr_str(one_hot("pv", 21, width=11)).alias("onehot"))


def q_multi_hot(spark, sf):
    return _codes(spark, sf).select("sample_id", arr_str(multi_hot("codes", 100)).alias("counts"))


def q_attach_codes(spark, sf):
    out = attach_sample_codes(S.seq_table(spark, sf), _codes(spark, sf))
    return out.select("doc_id", "pos", "sample_id", arr_str("codes").alias("codes"))


def q_unmatched_letters(spark, sf):
    w = S.labelled_words(spark, sf, "^[A-Z]{8,11}$")
    codes = encode_letters("seq", strict=False)
    return w.filter(F.exists(codes, lambda x: x.isNull())).select("doc_id", "pos", "seq")


def q_encode_rejects(spark, sf):
    """Reject mode over all words of 6..13 letters: why each rejected word fails."""
    w = S.labelled_words(spark, sf, "^[A-Z]{6,13}$").withColumn(
        "sample_id", (F.col("doc_id") % S.N_SEQ_SAMPLES).cast("bigint"))
    _, rejects = encode_examples_checked(w, _codes(spark, sf), "base")
    return rejects.select("doc_id", "pos", "seq", "reason")


def q_unmatched_terms(spark, sf):
    # a dictionary that knows the first brands only
    long = unpivot_slots(S.slots_wide(spark, sf))
    known = S.voc_table(spark, sf).where(F.col("term") < KNOWN_BELOW)
    return unmatched_terms(long, known).select("sample_id", "slot", "term")


def q_slice_features(spark, sf):
    ex = encode_examples(S.seq_table(spark, sf), _codes(spark, sf), "abundance")
    pep, al, ab = slice_features("vec", [11, 6, 1], ["peptide", "alleles", "abundance"])
    return ex.select("doc_id", "pos", arr_str(pep).alias("peptide"),
                     arr_str(al).alias("alleles"), r6(F.element_at(ab, 1)).alias("abundance"))


# ------------------------------------------------------------ lines / split

def _doc_lines(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def q_clean_lines(spark, sf):
    out = text.clean_lines(_doc_lines(spark, sf))
    return out.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "value")


def _unsplit_lines(spark, sf):
    s = S.seq_table(spark, sf)
    # label field = quality + toxic, so 2 occurs and is dropped by the split
    return s.select("doc_id", "pos", F.concat_ws(
        "\t", "seq", F.col("abundance").cast("string"),
        (F.col("label") + F.col("toxic")).cast("string")).alias("value"))


def q_split_pos(spark, sf):
    return split.positives(_unsplit_lines(spark, sf)).select("doc_id", "pos", "value")


def q_split_neg(spark, sf):
    return split.negatives(_unsplit_lines(spark, sf)).select("doc_id", "pos", "value")


def q_class_counts(spark, sf):
    return metrics.class_counts(S.seq_table(spark, sf), by=["sample_id"])


# ---------------------------------------------------------------- sampling

def _lineitem(spark, sf):
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")


def q_sample_bernoulli(spark, sf):
    return sampling.sample_rows(_lineitem(spark, sf), FRACTION, seed=SEED).select(
        "l_orderkey", "l_linenumber")


def q_sample_hash(spark, sf):
    return sampling.sample_by_key(_lineitem(spark, sf), ["l_orderkey", "l_linenumber"],
                                  FRACTION).select("l_orderkey", "l_linenumber")


def q_downsample_negatives(spark, sf):
    li = _lineitem(spark, sf).withColumn(
        "label", (F.col("l_returnflag") == "R").cast("int"))
    out = sampling.downsample_class(li, "label", ["l_orderkey", "l_linenumber"], FRACTION,
                                    sampled_value=0, seed=SEED)
    return out.select("l_orderkey", "l_linenumber", "label")


def q_balanced_batches(spark, sf):
    out = batching.balanced_batches(_lineitem(spark, sf), "l_returnflag",
                                    ["l_orderkey", "l_linenumber"], BATCH_PER_CLASS, seed=SEED)
    return out.select("batch", "slot", "l_returnflag", "l_orderkey", "l_linenumber")


def q_sequential_batches(spark, sf):
    # SEQ is derived from whole texts: written once, then read by the three passes
    out = batching.sequential_batches(S.seq_table(spark, sf), SEQUENTIAL_ROWS,
                                      order=["doc_id", "pos"], split_col="doc_id",
                                      lead=["label"], by=["sample_id"], checkpoint_input=True)
    return out.select("sample_id", "doc_id", "pos", "label", "rn", "batch")


# ----------------------------------------------------------------- metrics

def q_log_loss(spark, sf):
    return metrics.mean_log_loss(S.scored_table(spark, sf)).select(r6("log_loss").alias("log_loss"))


def q_roc_auc(spark, sf):
    return metrics.roc_auc(S.scored_table(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


def q_pr_auc(spark, sf):
    return metrics.pr_auc(S.scored_table(spark, sf)).select(r6("pr_auc").alias("pr_auc"))


def q_eval_by_sample(spark, sf):
    out = metrics.evaluate_by_sample(S.scored_table(spark, sf))
    return out.select("sample_id", "n_pos", "n_neg", r6("roc_auc").alias("roc_auc"),
                      r6("pr_auc").alias("pr_auc"), r6("log_loss").alias("log_loss"))


def q_activations(spark, sf):
    sc = S.scored_table(spark, sf)
    x = F.col("score") - F.lit(15.0)
    return sc.select("doc_id", "pos", r6(relu(x)).alias("relu"), r6(sigmoid(x)).alias("sigmoid"))


# ----------------------------------------------------------------- scoring

def _examples(spark, sf, variant="base"):
    src = S.seq_flank_table(spark, sf) if variant == "flank" else S.seq_table(spark, sf)
    return encode_examples(src, _codes(spark, sf), variant)


def q_linear(spark, sf):
    """The abundance branch (1 -> 16 -> ReLU -> 1) as JVM expressions."""
    cfg = scoring.ScorerConfig("abundance")
    w = scoring.rule_weights(cfg).arrays
    s = S.seq_table(spark, sf).select("doc_id", "pos", F.array("abundance").alias("x"))
    h = s.select("doc_id", "pos", affine("x", w["A1"], w["a1"], activation="relu").alias("h"))
    y = h.select("doc_id", "pos", affine("h", w["A2"], w["a2"]).alias("y"))
    return y.select("doc_id", "pos", r6(F.element_at("y", 1)).alias("y"))


def q_linear_arrow(spark, sf):
    """The same branch through the NumPy/Arrow layer (the form wide layers use)."""
    cfg = scoring.ScorerConfig("abundance")
    w = scoring.rule_weights(cfg).arrays
    s = S.seq_table(spark, sf).select("doc_id", "pos", F.array("abundance").alias("x"))
    h = scoring.linear_layer(s, "x", w["A1"], w["a1"], activation="relu", out="h")
    y = scoring.linear_layer(h, "h", w["A2"], w["a2"], out="y")
    return y.select("doc_id", "pos", r6(F.element_at("y", 1)).alias("y"))


def q_masked_score(spark, sf):
    cfg = scoring.ScorerConfig("base")
    out = scoring.score_examples(_examples(spark, sf), scoring.rule_weights(cfg), cfg)
    return out.select("doc_id", "pos", "sample_id", "label", r6("score").alias("score"))


def q_masked_score_abundance(spark, sf):
    cfg = scoring.ScorerConfig("abundance")
    out = scoring.score_examples(_examples(spark, sf, "abundance"), scoring.rule_weights(cfg), cfg)
    return out.select("doc_id", "pos", "sample_id", "label", r6("score").alias("score"))


def q_masked_score_flank(spark, sf):
    cfg = scoring.ScorerConfig("flank")
    out = scoring.score_examples(_examples(spark, sf, "flank"), scoring.rule_weights(cfg), cfg)
    return out.select("doc_id", "pos", "sample_id", "label", r6("score").alias("score"))


def q_eval_model(spark, sf):
    """Score every example with the model and evaluate per sample.

    Scores are compared at 1e-9: float sums in another order would otherwise
    split exact ties and move the tie-sensitive areas."""
    cfg = scoring.ScorerConfig("base")
    sc = scoring.score_examples(_examples(spark, sf), scoring.rule_weights(cfg), cfg)
    out = metrics.evaluate_by_sample(sc.withColumn("score", F.round("score", 9)))
    return out.select("sample_id", "n_pos", "n_neg", r6("roc_auc").alias("roc_auc"),
                      r6("pr_auc").alias("pr_auc"), r6("log_loss").alias("log_loss"))


def _written_scores(spark, sf):
    cfg = scoring.ScorerConfig("base")
    return observed.write_scored(_examples(spark, sf), scoring.rule_weights(cfg), scratch_path(spark, "scored"), cfg)


def q_scored_written(spark, sf):
    """The table of scores as written, whose figures ``scored_figures`` shows."""
    return _written_scores(spark, sf)[0].select("doc_id", "pos", "sample_id", "label", r6("score").alias("score"))


def q_scored_figures(spark, sf):
    """Figures observed while the scores were written, beside those of the table read back."""
    table, seen = _written_scores(spark, sf)
    rows = [(k, None if v is None else float(v)) for k, v in seen.items()]
    recounted = table.agg(*observed.figures()).select(F.explode(F.create_map(*[
        c for k in observed.FIGURES for c in (F.lit(k), F.col(k).cast("double"))])).alias("figure", "v"))
    return recounted.join(F.broadcast(spark.createDataFrame(rows, "figure string, seen double")), "figure") \
        .select("figure", r6("seen").alias("observed"), r6("v").alias("recounted"))


def q_eval_held_out(spark, sf):
    """The held-out samples read back from the written examples (directory
    pruning), scored and evaluated per sample, as the reference's listeners do."""
    cfg = scoring.ScorerConfig("base")
    held = dataset.read_sample(spark, _examples_dir(spark, sf), list(range(N_TEST_SAMPLES)))
    held = held.withColumn("sample_id", F.col("sample_id").cast("bigint")).withColumn(
        "label", F.col("label").cast("int"))
    sc = scoring.score_examples(held, scoring.rule_weights(cfg), cfg)
    out = metrics.evaluate_by_sample(sc.withColumn("score", F.round("score", 9)))
    return out.select("sample_id", "n_pos", "n_neg", r6("roc_auc").alias("roc_auc"),
                      r6("pr_auc").alias("pr_auc"), r6("log_loss").alias("log_loss"))


def off_kink_weights(cfg):
    """Rule weights with OFF_KINK added to the hidden biases: rule values are multiples of
    a few fractions, so sums of zero, where a ReLU's derivative would follow the order of
    summation, do not occur."""
    w = scoring.rule_weights(cfg)
    for name, by in OFF_KINK.items():
        if name in w.arrays:
            w.arrays[name] = w.arrays[name] + by
    return w


def _gradients(spark, sf, variant, hidden):
    cfg = scoring.ScorerConfig(variant, hidden=hidden)
    w = off_kink_weights(cfg) if hidden == SMALL_HIDDEN else scoring.rule_weights(cfg)
    # small slices, so several reducers and the two levels of sums take part
    slices = scoring.gradient_sums(_examples(spark, sf, variant), w, cfg, slice_size=256, fan_in=4)
    return scoring.gradient_components(slices, w, slice_size=256)


def q_gradient_sums(spark, sf):
    """Output biases of the full-size model: one row per category."""
    g = _gradients(spark, sf, "base", 256).where("name = 'b2'")
    return g.select(F.col("i").alias("k"), r6("g").alias("g"))


def _q_gradients(variant):
    def query(spark, sf):
        """Every component of the summed gradient (small hidden layer, rule weights)."""
        g = _gradients(spark, sf, variant, SMALL_HIDDEN)
        return g.select("name", "i", "j", (F.round("g", 4) + F.lit(0.0)).alias("g"))
    return query


def q_fit_losses(spark, sf):
    """Mean loss before and after one Adam step on all examples (rule weights, no dropout)."""
    cfg = scoring.ScorerConfig("base", hidden=SMALL_HIDDEN)
    _, hist = scoring.fit_scorer(_examples(spark, sf), cfg, steps=2, lr=FIT_RATE, dropout=False,
                                 init=off_kink_weights(cfg))
    out = spark.createDataFrame(hist, "step int, loss double, rows long")
    return out.select("step", r6("loss").alias("loss"), "rows")


def q_dropout_mask(spark, sf):
    s = S.seq_table(spark, sf).select("doc_id", "pos")
    return scoring.dropout_kept(s, ["doc_id", "pos"], MASK_UNITS, MASK_STEPS, KEEP, seed=SEED)


def _numbered(spark, sf):
    return epochs.numbered_classes(_lineitem(spark, sf), "l_returnflag", ["l_orderkey", "l_linenumber"], seed=SEED)


def q_epoch_order(spark, sf):
    """Two epochs of every class, each a permutation of its rows."""
    out = epochs.epoch_order(_numbered(spark, sf), "l_returnflag", FIRST_EPOCH, LAST_EPOCH, seed=SEED)
    return out.select("epoch", "position", "l_returnflag", "l_orderkey", "l_linenumber")


def q_epoch_batches(spark, sf):
    """Balanced batches for two epochs of the largest class, from a later batch on."""
    numbered = _numbered(spark, sf)
    most = numbered.agg(F.max("class_rows")).first()[0] or 0
    first = most // BATCH_PER_CLASS
    out = epochs.balanced_stream(numbered, "l_returnflag", BATCH_PER_CLASS, first, first + 2 * (most // BATCH_PER_CLASS),
                                 seed=SEED)
    return out.select("batch", "slot", "epoch", "l_returnflag", "l_orderkey", "l_linenumber")


def q_downsample_exact(spark, sf):
    li = _lineitem(spark, sf).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    out = exact_sampling.downsample_exact(li, "label", ["l_orderkey", "l_linenumber"], EXACT_FRACTION,
                                          by=["l_linenumber"], seed=SEED)
    return out.select("l_orderkey", "l_linenumber", "label")


def q_sample_bernoulli_check(spark, sf):
    """What holds for any Bernoulli sample: rows of the table, each once, about the share."""
    whole, kept = _lineitem(spark, sf), sampling.sample_rows(_lineitem(spark, sf), FRACTION, seed=SEED)
    again = sampling.sample_rows(_lineitem(spark, sf), FRACTION, seed=SEED)
    keys = ["l_orderkey", "l_linenumber"]

    def per_key(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = per_key(whole, "m").join(per_key(kept, "k"), keys, "full_outer").join(per_key(again, "a"), keys, "full_outer")
    m, k, a = (F.coalesce(c, F.lit(0)) for c in ("m", "k", "a"))
    share = F.abs(F.sum(k) - F.sum(m) * FRACTION) < 6 * F.sqrt(F.sum(m) * (FRACTION * (1 - FRACTION)))
    return both.agg(F.sum(m).alias("rows"), F.min(k <= m).alias("each_once"), share.alias("about_the_share"),
                    F.min(k == a).alias("same_with_same_seed"))


def q_binned_areas(spark, sf):
    """Thresholded ROC and PR areas per sample, their bounds, and the exact areas."""
    scored = S.scored_table(spark, sf)
    even = F.col("doc_id") % 2 == 0
    halves = [curves.score_bins(scored.where(c), SCORE_LOW, SCORE_HIGH, SCORE_BINS, by=["sample_id"])
              for c in (even, ~even)]
    binned = curves.binned_areas(curves.merge_bins(*halves, by=["sample_id"]), by=["sample_id"])
    exact = metrics.evaluate_by_sample(scored).select("sample_id", F.col("roc_auc").alias("exact_roc"),
                                                      F.col("pr_auc").alias("exact_pr"))
    slack = F.lit(1e-9)
    return binned.join(exact, "sample_id").select(
        "sample_id", "n_pos", "n_neg", r6("roc_auc").alias("roc_auc"), r6("roc_bound").alias("roc_bound"),
        r6("pr_auc").alias("pr_auc"), r6("pr_low").alias("pr_low"), r6("pr_high").alias("pr_high"),
        (F.abs(F.col("roc_auc") - F.col("exact_roc")) <= F.col("roc_bound") + slack).alias("roc_within"),
        F.col("exact_pr").between(F.col("pr_low") - slack, F.col("pr_high") + slack).alias("pr_within"))


def q_slice_float32(spark, sf):
    """Example vectors sliced as 32-bit floats, as a trainer reads them."""
    ex = encode_examples(S.seq_table(spark, sf), _codes(spark, sf), "abundance")
    pep, al, ab = slice_features(F.col("vec").cast("array<float>"), [11, 6, 1], ["peptide", "alleles", "abundance"])
    return ex.select("doc_id", "pos", F.element_at(pep, 1).alias("first"), F.element_at(al, 6).alias("last"),
                     F.element_at(ab, 1).alias("abundance"))


def q_fit_scorer(spark, sf):
    """Three Adam steps, each on one balanced batch (n examples of each class)."""
    cfg = scoring.ScorerConfig("base")
    ex = _examples(spark, sf)
    batches = batching.balanced_batches(ex, "label", ["doc_id", "pos"], BATCH_PER_CLASS,
                                        seed=SEED, checkpoint_input=True)
    _, hist = scoring.fit_scorer(batches, cfg, steps=3, lr=1e-2, seed=SEED,
                                 keys=["doc_id", "pos", "slot"], batch_col="batch")
    return spark.createDataFrame(hist, "step int, loss double, rows long")


# ------------------------------------------------------------ sources/sinks

def _labelled_lines_dir(spark, sf, fields: int) -> str:
    s = S.seq_table(spark, sf).withColumn("split", _split_col())
    parts = ["seq"] + (["abundance"] if fields == 3 else []) + ["label"]
    lines = s.select(
        F.concat_ws("\t", *[F.col(c).cast("string") for c in parts]).alias("value"), "split",
        F.concat(F.lit("sample_"), F.col("sample_id").cast("string"), F.lit("_"),
                 F.when(F.col("label") == 1, "pos").otherwise("neg"), F.lit(".txt")).alias("file"))
    path = scratch_path(spark, f"labelled{fields}")
    sinks.write_lines(lines, path, partition_by=["split", "file"])
    return path


def _sample_num(c: str = "sample") -> Column:
    return F.regexp_extract(F.col(c), r"(\d+)$", 1).cast("bigint")


def q_read_labelled2(spark, sf):
    df = text.read_labelled(spark, _labelled_lines_dir(spark, sf, 2), fields=2)
    return df.select("seq", "label", _sample_num().alias("sample_id"), "split")


def q_read_labelled3(spark, sf):
    df = text.read_labelled(spark, _labelled_lines_dir(spark, sf, 3), fields=3)
    return df.select("seq", r6("abundance").alias("abundance"), "label",
                     _sample_num().alias("sample_id"), "split")


def q_path_columns(spark, sf):
    lines = text.with_path_columns(text.scan_lines(spark, _labelled_lines_dir(spark, sf, 2)))
    return lines.groupBy("split", "sample", "path_label").agg(F.count(F.lit(1)).alias("n"))


def _manifest(spark, sf):
    samples = S.seq_table(spark, sf).select("sample_id").distinct().select(
        _split_col().alias("split"),
        F.concat(F.lit("sample_"), F.col("sample_id").cast("string")).alias("sample"))
    return dataset.dataset_manifest(samples, id_col="sample")


def q_manifest(spark, sf):
    return _manifest(spark, sf).select("split", "sample", "cls", "file")


def _expected_files(spark, sf):
    """Expected samples: one in N_EXPECTED of the documents' ids, but two; the files hold
    N_SEQ_SAMPLES samples, so some are missing and some surplus."""
    ids = S.table(spark, sf, "documents").select((F.col("doc_id") % N_EXPECTED).cast("bigint").alias("sample_id")) \
        .where(~F.col("sample_id").isin(*NOT_EXPECTED)).distinct()
    samples = ids.select(_split_col().alias("split"),
                         F.concat(F.lit("sample_"), F.col("sample_id").cast("string")).alias("sample"))
    return dataset.dataset_manifest(samples, id_col="sample")


def q_file_listing(spark, sf):
    """Metadata of the files found: no file is opened."""
    found = dataset.listed_files(dataset.file_listing(spark, _labelled_lines_dir(spark, sf, 2)))
    return found.select("split", "file", "cls", "bytes")


def q_manifest_missing(spark, sf):
    found = dataset.listed_files(dataset.file_listing(spark, _labelled_lines_dir(spark, sf, 2)))
    return dataset.check_complete(_expected_files(spark, sf), found)


def q_manifest_files(spark, sf):
    """The files that are not as expected, by name."""
    found = dataset.listed_files(dataset.file_listing(spark, _labelled_lines_dir(spark, sf, 2)))
    return dataset.reconcile(_expected_files(spark, sf), found).where("status <> 'present'")


def _examples_dir(spark, sf) -> str:
    ex = _examples(spark, sf).withColumn("split", _split_col())
    path = scratch_path(spark, "examples")
    sinks.write_examples(ex.select("doc_id", "pos", "vec", "split", "sample_id", "label"), path)
    return path


def q_class_sets(spark, sf):
    pos, neg = dataset.read_class_sets(spark, _examples_dir(spark, sf), "train")
    out = pos.unionByName(neg)
    return out.select("doc_id", "pos", F.col("sample_id").cast("bigint").alias("sample_id"),
                      F.col("label").cast("int").alias("label"), arr_str("vec").alias("vec"))


def q_sample_set(spark, sf):
    df = dataset.read_sample(spark, _examples_dir(spark, sf), list(range(N_TEST_SAMPLES)))
    df = df.withColumn("sample_id", F.col("sample_id").cast("bigint")).withColumn(
        "label", F.col("label").cast("int"))
    out = batching.sequential_batches(df, SEQUENTIAL_ROWS, order=["doc_id", "pos"],
                                      split_col="doc_id", lead=["label"], by=["sample_id"])
    return out.select("doc_id", "pos", "sample_id", "label", arr_str("vec").alias("vec"), "rn")


def q_examples_roundtrip(spark, sf):
    df = dataset.read_examples(spark, _examples_dir(spark, sf))
    return df.select("doc_id", "pos", F.col("sample_id").cast("bigint").alias("sample_id"),
                     F.col("label").cast("int").alias("label"), "split",
                     arr_str("vec").alias("vec"))


def q_dictionary_roundtrip(spark, sf):
    path = scratch_path(spark, "dictionaries")
    sinks.save_dictionaries(sinks.residue_table(spark), _codes(spark, sf), path,
                            vocab=S.voc_table(spark, sf))
    residues, samples = sinks.load_dictionaries(spark, path)
    vocab = sinks.load_vocab(spark, path)
    return samples.select(F.lit("samples").alias("dictionary"), F.col("sample_id").cast("string").alias("key"),
                          arr_str("codes").alias("codes")) \
        .unionByName(residues.select(F.lit("residues").alias("dictionary"), F.col("letter").alias("key"),
                                     F.col("code").cast("string").alias("codes"))) \
        .unionByName(vocab.select(F.lit("vocab").alias("dictionary"), F.col("term").alias("key"),
                                  F.col("code").cast("string").alias("codes")))


def q_text_roundtrip(spark, sf):
    lines = _unsplit_lines(spark, sf).select("value")
    path = scratch_path(spark, "lines")
    sinks.write_lines(lines, path)
    return text.scan_lines(spark, path).select("value")


def q_read_vocab(spark, sf):
    voc = S.voc_table(spark, sf)
    path = scratch_path(spark, "vocab")
    # several files: the lines are numbered across them in path order
    sinks.write_ordered_lines(voc.select(F.col("term").alias("value"), "code"), path, ["code"], n_files=VOCAB_FILES)
    return text.read_vocab(spark, path)


def q_vocab_versions(spark, sf):
    """Every snapshot of a vocabulary that grows from brands over types to part names."""
    path = scratch_path(spark, "vocab-versions")
    part = S.table(spark, sf, "part")
    steps = [["p_brand"], ["p_type", "p_brand"], ["p_name", "p_type"]]
    snapshots = []
    for version, cols in enumerate(steps, 1):
        terms = part.select(F.explode(F.array(*cols)).alias("term"))
        snapshots.append(vocabulary.add_version(spark, path, version, terms)
                         .select(F.lit(version).alias("version"), "term", "code"))
    return snapshots[0].unionByName(snapshots[1]).unionByName(snapshots[2])


# --------------------------------------------------------- bucketed examples

def _bucketed_seq(spark, sf) -> str:
    name = "epiframe_seq_" + uuid.uuid4().hex[:12]
    bucketed.write_bucketed(S.seq_table(spark, sf), name, scratch_path(spark, "bucketed"), "sample_id",
                            ["label", "doc_id", "pos"], EXAMPLE_BUCKETS)
    return name


def q_bucketed_codes(spark, sf):
    """J1 on tables stored in buckets: no exchange."""
    name = _bucketed_seq(spark, sf)
    bucketed.write_bucketed_dimension(spark, _codes(spark, sf), name, f"{name}_codes",
                                      scratch_path(spark, "bucketed-codes"), "sample_id")
    out = bucketed.attach_bucketed(spark, name, f"{name}_codes", "sample_id", "codes")
    return out.select("doc_id", "pos", "sample_id", arr_str("codes").alias("codes"))


def q_bucketed_batches(spark, sf):
    """B5 on a table stored in buckets: no exchange."""
    out = bucketed.number_bucketed(spark, _bucketed_seq(spark, sf), "sample_id", ["label", "doc_id", "pos"],
                                   SEQUENTIAL_ROWS)
    return out.select("sample_id", "doc_id", "pos", "label", "rn", "batch")


def q_read_slots(spark, sf):
    path = scratch_path(spark, "slots")
    S.slots_wide(spark, sf).write.option("header", "true").csv(path)
    df = text.read_slots(spark, path)
    return df.select(F.col("sample_id").cast("bigint").alias("sample_id"),
                     *[c for c in df.columns if c != "sample_id"])


QUERIES: dict[str, Query] = {
    # encoding (E1-E8), look-ups (J1-J3), projections
    "encode_letters": q_encode_letters,
    "pad_middle": q_pad_middle,
    "encode_slots": q_encode_slots,
    "assemble17": q_assemble17,
    "assemble18": q_assemble18,
    "assemble28": q_assemble28,
    "one_hot": q_one_hot,
    "multi_hot": q_multi_hot,
    "attach_codes": q_attach_codes,
    "unmatched_letters": q_unmatched_letters,
    "unmatched_terms": q_unmatched_terms,
    "encode_rejects": q_encode_rejects,
    "slice_features": q_slice_features,
    "slice_float32": q_slice_float32,
    "clean_lines": q_clean_lines,
    "split_pos": q_split_pos,
    "split_neg": q_split_neg,
    "class_counts": q_class_counts,
    # sampling and batching
    "sample_bernoulli": q_sample_bernoulli,
    "sample_hash": q_sample_hash,
    "downsample_negatives": q_downsample_negatives,
    "balanced_batches": q_balanced_batches,
    "sequential_batches": q_sequential_batches,
    "epoch_order": q_epoch_order,
    "epoch_batches": q_epoch_batches,
    "downsample_exact": q_downsample_exact,
    "sample_bernoulli_check": q_sample_bernoulli_check,
    # metrics (A2-A5)
    "log_loss": q_log_loss,
    "roc_auc": q_roc_auc,
    "pr_auc": q_pr_auc,
    "eval_by_sample": q_eval_by_sample,
    "binned_areas": q_binned_areas,
    # scoring (M1-M8)
    "activations": q_activations,
    "linear": q_linear,
    "linear_arrow": q_linear_arrow,
    "masked_score": q_masked_score,
    "masked_score_abundance": q_masked_score_abundance,
    "masked_score_flank": q_masked_score_flank,
    "eval_model": q_eval_model,
    "eval_held_out": q_eval_held_out,
    "scored_written": q_scored_written,
    "scored_figures": q_scored_figures,
    "gradient_sums": q_gradient_sums,
    "gradients_base": _q_gradients("base"),
    "gradients_abundance": _q_gradients("abundance"),
    "gradients_flank": _q_gradients("flank"),
    "fit_losses": q_fit_losses,
    "dropout_mask": q_dropout_mask,
    "fit_scorer": q_fit_scorer,
    # sources and sinks
    "read_vocab": q_read_vocab,
    "read_slots": q_read_slots,
    "read_labelled2": q_read_labelled2,
    "read_labelled3": q_read_labelled3,
    "path_columns": q_path_columns,
    "manifest": q_manifest,
    "file_listing": q_file_listing,
    "manifest_missing": q_manifest_missing,
    "manifest_files": q_manifest_files,
    "class_sets": q_class_sets,
    "sample_set": q_sample_set,
    "examples_roundtrip": q_examples_roundtrip,
    "dictionary_roundtrip": q_dictionary_roundtrip,
    "text_roundtrip": q_text_roundtrip,
    "vocab_versions": q_vocab_versions,
    "bucketed_codes": q_bucketed_codes,
    "bucketed_batches": q_bucketed_batches,
}
