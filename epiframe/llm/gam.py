"""Operator 13: document quality by an additive model with pairwise interactions.

score = sigmoid(b + sum of T_f[bin of f] + sum of T_fg[bin of f, bin of g])

Statistics of whole texts are computed once per document in Arrow batches and written.
The tables T are learned on a bounded sample of labelled rows by cyclic boosting: every
cycle visits the statistics in turn and adds a small step of one shallow regression tree
on the bins of that statistic alone, fitted to the log loss, so a statistic cannot hide
behind a stronger one. When the cycles no longer help on the rows held back, pairs are
ranked by what a coarse two-way table would still gain, and the best ones are boosted in
the same way. A document is scored by looking up its bins and adding.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, prepare_python, table

SAMPLE_PER_CLASS = 10_000   # labelled rows of a class the model is fitted on, by hash (give or take its chance)
BINS, PAIR_BINS = 64, 12
CYCLES, PAIR_CYCLES = 400, 150
N_PAIRS = 8
RATE = 0.08
LEAVES = 4
MIN_LEAF = 8                # rows of a leaf
RIDGE = 1.0                 # added to the second derivatives of a leaf
PATIENCE = 30               # cycles without a gain on the rows held back
SEED = 13

FEATURES = ("log_bytes", "upper", "lower", "digit", "high", "space", "newline", "bang", "pipe", "symbol",
            "stop", "punct", "mean_word", "long_word", "distinct_words", "distinct_lines", "distinct_triples",
            "short_words", "entropy", "runs")

# Bytes of each counted kind.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "newline": b"\n", "bang": b"!?", "pipe": b"|/\\<>=_{}[]", "symbol": b"#*$%&@~^+",
    "stop": b".", "punct": b",;:'\"()-",
}


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a NULL id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 1


def text_statistics(texts: list[bytes]):
    """Matrix of :data:`FEATURES`, one row a text. Shares are of the text's bytes or of
    its words; an empty text has zeros throughout."""
    import numpy as np
    out = np.zeros((len(texts), len(FEATURES)))
    col = {f: i for i, f in enumerate(FEATURES)}
    kind = np.zeros(256, np.int64)
    names = list(KINDS)
    for i, k in enumerate(names, 1):
        kind[list(KINDS[k])] = i
    kind[128:] = len(names) + 1
    for r, text in enumerate(texts):
        if not text:
            continue
        row = out[r]
        raw = np.frombuffer(text, np.uint8)
        seen = np.bincount(raw, minlength=256)
        size = len(raw)
        share = np.bincount(kind, weights=seen, minlength=len(names) + 2) / size
        for i, k in enumerate(names, 1):
            row[col[k]] = share[i]
        row[col["high"]] = share[-1]
        used = seen[seen > 0] / size
        row[col["entropy"]] = -(used * np.log2(used)).sum()
        row[col["runs"]] = np.count_nonzero(raw[1:] == raw[:-1]) / size
        row[col["log_bytes"]] = np.log1p(size)
        words = text.split()
        n = len(words)
        if n:
            lens = np.fromiter(map(len, words), np.int64, n)
            row[col["mean_word"]] = lens.mean()
            row[col["long_word"]] = np.log1p(lens.max())
            row[col["short_words"]] = (lens <= 2).mean()
            row[col["distinct_words"]] = len(set(words)) / n
            row[col["distinct_triples"]] = len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1)
        lines = [x for x in text.split(b"\n") if x.strip()]
        if lines:
            row[col["distinct_lines"]] = len(set(lines)) / len(lines)
    return out


def with_text_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row of ``docs``; NULL texts count as empty."""
    prepare_python(docs.sparkSession)
    id_type = docs.schema[id_col].dataType

    def run(batches):
        import numpy as np
        import pyarrow as pa
        width = len(FEATURES)
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(1)
            raw = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            x = text_statistics(raw.to_pylist())
            ends = pa.array(np.arange(0, x.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                                             names=["doc_id", "x"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {id_type.simpleString()}, x array<double>")


@dataclass
class Model:
    """Bin edges, intercept and lookup tables; ``coarse`` maps fine to pair bins."""
    edges: list
    intercept: float
    tables: list
    coarse: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def bins(self, x):
        import numpy as np
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, x):
        b = self.bins(x)
        out = self.intercept + sum(t[b[:, f]] for f, t in enumerate(self.tables))
        for (f, g), t in self.pairs.items():
            out = out + t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return out

    def score(self, x):
        import numpy as np
        return 0.5 * (1.0 + np.tanh(0.5 * self.margin(x)))


def quantile_edges(x, bins: int):
    """Ascending cuts between distinct values, at most ``bins - 1``."""
    import numpy as np
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="midpoint"))


def tree_on_bins(grad, hess, rows, leaves: int = LEAVES):
    """Step of each bin from a regression tree of at most ``leaves`` ranges of bins,
    grown by the best gain first (Newton steps; sums given per bin)."""
    import numpy as np

    def worth(g, h):
        return g * g / (h + RIDGE)

    parts = [(0, len(grad))]
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (grad, hess, rows))
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            cut = np.arange(a + 1, b)
            cut = cut[(cn[cut] - cn[a] >= MIN_LEAF) & (cn[b] - cn[cut] >= MIN_LEAF)]
            if not len(cut):
                continue
            gain = worth(cg[cut] - cg[a], ch[cut] - ch[a]) + worth(cg[b] - cg[cut], ch[b] - ch[cut]) \
                - worth(cg[b] - cg[a], ch[b] - ch[a])
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (gain[i], k, int(cut[i]))
        if best is None:
            break
        _, k, c = best
        a, b = parts[k]
        parts[k:k + 1] = [(a, c), (c, b)]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return step


def tree_on_pair(grad, hess, rows):
    """Step of each cell from a tree of depth two over a two-way table: one cut of either
    axis, then one cut of the other axis (or none) in each half."""
    import numpy as np
    best = None
    for axis in (0, 1):
        g, h, n = (v if axis == 0 else v.T for v in (grad, hess, rows))
        for cut in range(1, g.shape[0]):
            steps, gain = [], 0.0
            for half in (slice(0, cut), slice(cut, None)):
                gs, hs, ns = g[half].sum(0), h[half].sum(0), n[half].sum(0)
                if ns.sum() < MIN_LEAF:
                    break
                s = tree_on_bins(gs, hs, ns, leaves=2)
                gain += float(-(s * gs + 0.5 * s * s * (hs + RIDGE * hs / max(hs.sum(), 1e-12))).sum())
                steps.append(s)
            if len(steps) == 2 and (best is None or gain > best[0] + 1e-12):
                best = (gain, axis, cut, steps)
    out = np.zeros(grad.shape)
    if best is not None:
        _, axis, cut, (left, right) = best
        view = out if axis == 0 else out.T
        view[:cut], view[cut:] = left, right
    return out, (best[0] if best else 0.0)


def fit(x, y, seed: int = SEED) -> Model:
    """The model of numpy rows; a quarter of them is held back to end the cycles.

    Classes weigh the same. Rows of one class only give a constant: the score is that
    class (1 or 0 is approached, 0.5 without any row)."""
    import numpy as np
    n, width = len(x), x.shape[1]
    edges = [quantile_edges(x[:, f], BINS) if n else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    pos = int(y.sum())
    if pos == 0 or pos == n:
        return Model(edges, 0.0 if n == 0 else (4.0 if pos else -4.0), tables)
    weight = np.where(y == 1, n / (2.0 * pos), n / (2.0 * (n - pos)))
    model = Model(edges, 0.0, tables)
    b = model.bins(x)
    model.coarse = [np.minimum(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for e in edges]
    back = np.random.default_rng(seed).permutation(n) % 4 == 0
    train = ~back if n >= 40 else np.ones(n, bool)
    if n < 40:
        back = train
    f_now = np.zeros(n)

    def sides():
        p = 0.5 * (1.0 + np.tanh(0.5 * f_now))
        return (p - y) * weight * train, np.maximum(p * (1 - p), 1e-6) * weight * train

    def loss():
        z = f_now[back]
        return float((weight[back] * (np.logaddexp(0, z) - y[back] * z)).mean())

    def cycle(visit, state, cycles: int):
        """Cycles until the rows held back stop gaining; the best state is kept."""
        nonlocal f_now
        best, kept, at = loss(), [t.copy() for t in state], 0
        start = f_now.copy()
        kept_f = start
        for c in range(cycles):
            visit()
            now = loss()
            if now < best - 1e-5:
                best, at, kept, kept_f = now, c, [t.copy() for t in state], f_now.copy()
            if c - at > PATIENCE:
                break
        for t, k in zip(state, kept):
            t[...] = k
        f_now = kept_f

    rows = train.astype(float)

    def visit_features():
        for f in range(width):
            if len(tables[f]) < 2:
                continue
            g, h = sides()
            m = len(tables[f])
            step = RATE * tree_on_bins(*(np.bincount(b[:, f], weights=v, minlength=m) for v in (g, h, rows)))
            tables[f] += step
            f_now[:] += step[b[:, f]]

    cycle(visit_features, tables, CYCLES)

    cells = {}

    def sums(f, g_):
        cell = cells[f, g_]
        g, h = sides()
        return tuple(np.bincount(cell, weights=v, minlength=PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)
                     for v in (g, h, rows))

    ranked = []
    for f in range(width):
        for g_ in range(f + 1, width):
            if len(tables[f]) > 1 and len(tables[g_]) > 1:
                cells[f, g_] = model.coarse[f][b[:, f]] * PAIR_BINS + model.coarse[g_][b[:, g_]]
                ranked.append((-tree_on_pair(*sums(f, g_))[1], f, g_))
    model.pairs = {(f, g_): np.zeros((PAIR_BINS, PAIR_BINS)) for _, f, g_ in sorted(ranked)[:N_PAIRS]}

    def visit_pairs():
        for (f, g_), t in model.pairs.items():
            step = RATE * tree_on_pair(*sums(f, g_))[0]
            t += step
            f_now[:] += step.ravel()[cells[f, g_]]

    cycle(visit_pairs, list(model.pairs.values()), PAIR_CYCLES)
    return model


def labelled_sample(stats: DataFrame, labels: DataFrame, quality: str = "quality", id_col: str = "doc_id",
                    per_class: int = SAMPLE_PER_CLASS) -> tuple:
    """(x, y) of about ``per_class`` labelled rows of each class (all, if fewer): those
    whose hash of (id, statistics) lies in the class's share of the hash range, in order
    of the hash. Each task picks its rows by itself; no class is brought to one task.

    Labels other than 0 and 1, NULL labels, and rows that are held out by their id do not
    count; a document labelled twice counts twice."""
    import numpy as np
    known = labels.select(F.col(id_col).alias("_lid"), F.col(quality).cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & F.col("_lid").isNotNull() & ~held_out(F.col("_lid")))
    joined = stats.join(known, F.col("doc_id") == F.col("_lid")).select(
        "x", "y", F.xxhash64("doc_id", "x").alias("h"))
    joined = materialise(joined, "gam-labelled")
    share = F.lit(0.0)
    for r in joined.groupBy("y").count().collect():  # two rows
        share = F.when(F.col("y") == r["y"], F.lit(min(1.0, per_class / r["count"]))).otherwise(share)
    rows = joined.where(F.pmod("h", F.lit(1 << 20).cast("long")) < share * (1 << 20)) \
        .collect()  # about 2 x per_class rows of FEATURES numbers
    rows.sort(key=lambda r: (r["h"], r["y"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return x, np.array([r["y"] for r in rows], np.int64)


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) by vectorised bin additions. The model's size is fixed by its
    bins, so it travels with the tasks."""
    prepare_python(stats.sparkSession)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(
        run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   quality: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Only whole texts enter a score: ids, language and source do not. NULL and empty texts
    are scored alike, by statistics of zero; equal texts have equal scores, whatever
    their ids; a document with a NULL id never meets a label. Without usable labels all
    scores are 0.5. An empty table gives no rows. Columns but id and text are not looked
    at, so their names cannot clash. A very long text is read whole by one task.
    """
    stats = materialise(with_text_statistics(docs, id_col, text), "gam-statistics")
    x, y = labelled_sample(stats, labels, quality, id_col)
    scored = score_statistics(stats, fit(x, y))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
