"""Operator 7: document quality by a learned decision list (DataFrame functions only).

The list is learned by sequential covering. Statistics of the labelled documents
are cut into threshold bins; each rule is grown condition by condition on two
thirds of the labels (largest FOIL gain), pruned from the end on the last third,
and kept while its precision there is high enough. Every count behind a decision
is one Spark aggregation over all labelled rows; the driver only sees
features x bins counts. The result is an ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, table, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

FEATURES = ("n_words", "word_chars", "mean_word_chars", "symbol_rate", "dup_line_rate",
            "repeat_word_rate", "distinct_word_rate", "n_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; a document that meets it is rejected."""
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def keep(self) -> Column:
        """Ordered conditional: the first rule that holds rejects, else keep."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def with_statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, carried columns and word statistics of the whole text.

    NULL and empty texts have no words and all counts 0. A word counts as repeated
    when it lies in a five-word window that occurs at least twice in the text
    (windows are compared by 64-bit hash within one document). Other columns of
    ``docs`` are ignored, so clashing names cannot interfere; repeated rows give
    repeated results. Each document is worked on inside its own row: no shuffle.
    """
    carried = [c for c in carry if c != id_col]
    base = docs.select(F.col(id_col), *carried, F.col(text).alias("_t"))
    staged = base.select(
        id_col, *carried, words_of(F.col("_t")).alias("_w"),
        F.coalesce(F.length("_t") - F.length(F.translate("_t", SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce("_t", F.lit("")), "\n"),
                 lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("_l"))
    counted = staged.select(
        id_col, *carried, "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    last = F.size("_h") - F.lit(WINDOW)
    win = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
    windows = counted.select(
        id_col, *carried, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines",
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"), win.alias("_win"))
    # Positions of windows seen more than once; only documents that have any pay for the sort.
    has_dup = F.size(F.array_distinct("_win")) < F.size("_win")
    ordered = windows.select(
        *[c for c in windows.columns if c != "_win"],
        F.when(has_dup, F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
        .alias("_z"))
    n = F.size("_z")
    same = F.filter("_z", lambda e, i: (
        (i > 0) & (F.get("_z", i - 1)["h"] == e["h"])) | (
        (i < n - 1) & (F.get("_z", i + 1)["h"] == e["h"])))
    positions = ordered.select(
        *[c for c in ordered.columns if c != "_z"],
        F.when(F.col("_z").isNotNull(), F.array_sort(F.transform(same, lambda e: e["p"]))).alias("_p"))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("e")),
        lambda a, p: F.struct((a["c"] + (p + WINDOW) - F.greatest(p.cast("long"), a["e"])).alias("c"),
                              (p + WINDOW).cast("long").alias("e")),
        lambda a: a["c"])
    return positions.select(
        *[c for c in positions.columns if c != "_p"],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """Add the learner's rates (0 where a text has no words or lines)."""
    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.withColumns({
        "mean_word_chars": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_word_rate": rate("n_repeat_words", "n_words"),
        "distinct_word_rate": rate("n_distinct", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | \
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn_decision_list(labelled: DataFrame, bad: Column, features: tuple[str, ...] = FEATURES,
                        bins: int = 32, max_rules: int = 6, max_conditions: int = 3,
                        min_precision: float = 0.95, min_cover: int = 5,
                        slack: float = 0.97,
                        id_col: str = "doc_id") -> DecisionList:
    """Sequential covering over all labelled rows; ``bad`` marks rows to reject.

    Rows with a NULL label are left out. Without any bad row the list is empty
    (everything is kept). Ties between tests go to the earlier feature; of one
    test, the strictest threshold with at least ``slack`` of the best gain is
    taken, so that clean rows near the boundary are kept.
    """
    probs = [i / bins for i in range(1, bins)]
    rows = labelled.select(
        F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(3)).alias("_fold"),
        bad.cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]) \
        .where("_y is not null")
    rows = materialise(rows, "quality-labelled")
    cuts: dict[str, list[float]] = {f: [] for f in features}
    for part in (rows, rows.where("_y = 1")):
        got = part.agg(*[F.percentile_approx(f, F.array(*map(F.lit, probs)), 10_000).alias(f)
                         for f in features]).first()
        for f in features:
            cuts[f] += list(got[f] or [])
    cuts = {f: sorted(set(v)) for f, v in cuts.items()}
    # bin of a value: number of cuts below it, so "bin <= b" means "value <= cuts[b]"
    def bin_of(f: str) -> Column:
        at = F.array(*[F.lit(c) for c in cuts[f]]) if cuts[f] else F.array().cast("array<double>")
        return F.size(F.filter(at, lambda c: F.col(f) > c))

    binned = rows.select("_fold", "_y", *features, F.array(*map(bin_of, features)).alias("_bins"))
    binned = materialise(binned, "quality-bins")
    found = DecisionList()
    left = binned

    def counts(df: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
        agg = df.select("_y", F.posexplode("_bins").alias("_f", "_b")).groupBy("_f", "_b") \
            .agg(F.sum("_y").alias("p"), F.count("*").alias("n")).collect()
        return {(r["_f"], r["_b"]): (r["p"], r["n"] - r["p"]) for r in agg}

    def pn(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
        return r["p"], r["n"] - r["p"]

    while len(found.rules) < max_rules:
        grow = left.where("_fold < 2")
        conds: list[Condition] = []
        p0, n0 = pn(grow)
        if p0 < min_cover:
            break
        while len(conds) < max_conditions and n0 > 0:
            table_ = counts(grow)
            seen: list[tuple[float, Condition, tuple[int, int]]] = []
            for i, f in enumerate(features):
                below_p = below_n = 0
                for b, cut in enumerate(cuts[f]):
                    p, n = table_.get((i, b), (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for above, (cp, cn) in ((False, (below_p, below_n)),
                                            (True, (p0 - below_p, n0 - below_n))):
                        if cp >= min_cover:
                            g = cp * (math.log2(cp / (cp + cn)) - math.log2(p0 / (p0 + n0)))
                            seen.append((g, Condition(f, above, cut), (cp, cn)))
            top = max(seen, key=lambda x: x[0], default=(0.0, None, None))
            best = None
            if top[0] > 1e-9:
                # of the same test, the strictest threshold that costs almost no gain
                near = [x for x in seen if x[0] >= slack * top[0] and x[1].feature == top[1].feature
                        and x[1].above == top[1].above]
                _, best, after = max(near, key=lambda x: x[1].threshold if top[1].above else -x[1].threshold)
            if best is None:
                break
            conds.append(best)
            grow = grow.where(best.column())
            p0, n0 = after
        if not conds:
            break
        check = left.where("_fold = 2")
        flags = []
        test = F.lit(True)
        for c in conds:
            test = test & c.column()
            flags.append(test)
        row = check.agg(*[F.coalesce(F.sum(F.when(t, F.col("_y"))), F.lit(0)).alias(f"p{i}") for i, t in enumerate(flags)],
                        *[F.count(F.when(t, F.lit(1))).alias(f"n{i}") for i, t in enumerate(flags)]).first()
        # prune from the end: the shortest prefix with the best worth (p - n) / (p + n)
        worth = [((2 * row[f"p{i}"] - row[f"n{i}"]) / row[f"n{i}"]) if row[f"n{i}"] else -1.0
                 for i in range(len(conds))]
        keep = max(range(len(conds)), key=lambda i: (worth[i], -i)) + 1
        p, n = row[f"p{keep - 1}"], row[f"n{keep - 1}"]
        if n == 0 or p / n < min_precision:
            break
        rule = Rule(tuple(conds[:keep]), p / n, n)
        found.rules.append(rule)
        left = left.where(~rule.column())
    return found


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                  quality: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every document.

    ``labels`` holds (id, quality 0/1); a document labelled twice counts twice, one
    without a label only gets the verdict. A document with a NULL id never joins a
    label. Empty tables give an empty result; without labels nothing but the base
    rule rejects.
    """
    stats = with_statistics(docs, text, id_col, carry)
    stats = materialise(stats, "quality-stats")
    featured = with_features(stats)
    lab = labels.select(F.col(id_col).alias("_lid"), F.col(quality).alias("_q")).where("_q is not null")
    labelled = featured.join(lab, featured[id_col] == F.col("_lid")).where(~base_failed())
    rules = learn_decision_list(labelled, F.col("_q") == 0, id_col=id_col)
    failed = base_failed()
    return featured.withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & rules.keep())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")
