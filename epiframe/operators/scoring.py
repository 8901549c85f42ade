"""Masked multi-category scorer: forward pass, gradients, fitting (M1-M9).

Model (one variant family, parameters below):

    peptide codes (11) --one-hot(depth)--> Linear(H) -> ReLU [-> dropout] -> Linear(C)
    [abundance (1) -> Linear(16) -> ReLU -> Linear(1)]         added to every logit
    [flank codes (10) --one-hot(depth)--> Linear(32) -> ReLU -> Linear(1)]  added too
    score = sum_k sigmoid(logit_k) * count_k(sample allele codes)

Allele code ``k`` (1..C) counts for category ``k``; code 0 counts nowhere. The
score, a sum of up to six probabilities, is then used as a logit by the loss and
the metrics (the reference does the same). The flank branch one-hot encodes the
flank codes (the reference one-hot encodes the peptide one-hot there, which
looks like a slip; see README).

Dense math runs in NumPy on Arrow record batches (``mapInArrow``: the vector
column is reshaped from the flat list buffer, no per-row Python); weights travel
in the task closure (their size is fixed by the model, not by the data).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed model sizes of the three variants.
VARIANTS = {
    "base": dict(width=17, n_aa=20, hidden=256, categories=100, abundance=False, flank=False),
    "abundance": dict(width=18, n_aa=20, hidden=256, categories=100, abundance=True, flank=False),
    "flank": dict(width=28, n_aa=22, hidden=256, categories=100, abundance=True, flank=True),
}
PEPTIDE, ALLELES, FLANK = 11, 6, 10
ABUNDANCE_HIDDEN, FLANK_HIDDEN = 16, 32
KEEP_PROB = 0.75


@dataclass
class ScorerConfig:
    variant: str = "base"
    hidden: int = 256
    categories: int = 100
    keep_prob: float = KEEP_PROB

    @property
    def spec(self) -> dict:
        return VARIANTS[self.variant]

    @property
    def depth(self) -> int:
        return self.spec["n_aa"] + 1

    @property
    def width(self) -> int:
        return self.spec["width"]


@dataclass
class Weights:
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def copy(self) -> "Weights":
        return Weights({k: v.copy() for k, v in self.arrays.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.arrays[k].ravel() for k in sorted(self.arrays)])

    def unflat(self, v: np.ndarray) -> "Weights":
        out, i = {}, 0
        for k in sorted(self.arrays):
            a = self.arrays[k]
            out[k] = v[i:i + a.size].reshape(a.shape)
            i += a.size
        return Weights(out)


def _shapes(cfg: ScorerConfig) -> dict[str, tuple]:
    d = cfg.depth
    s = {"W1": (PEPTIDE * d, cfg.hidden), "b1": (cfg.hidden,),
         "W2": (cfg.hidden, cfg.categories), "b2": (cfg.categories,)}
    if cfg.spec["abundance"]:
        s.update({"A1": (1, ABUNDANCE_HIDDEN), "a1": (ABUNDANCE_HIDDEN,),
                  "A2": (ABUNDANCE_HIDDEN, 1), "a2": (1,)})
    if cfg.spec["flank"]:
        s.update({"F1": (FLANK * d, FLANK_HIDDEN), "f1": (FLANK_HIDDEN,),
                  "F2": (FLANK_HIDDEN, 1), "f2": (1,)})
    return s


def rule_weights(cfg: ScorerConfig) -> Weights:
    """Deterministic weights from integer rules, so any engine can rebuild them
    (used by the SQL cross-checks; training starts from :func:`random_weights`)."""
    w = {}
    for name, shape in _shapes(cfg).items():
        w[name] = rule_array(name, shape)
    return Weights(w)


# Fixed values: (a, b, modulus, scale) of each rule, value = ((a*i + b*j) % m - m//2) / scale.
RULES = {
    "W1": (7, 13, 17, 40.0), "b1": (1, 0, 5, 10.0), "W2": (11, 3, 19, 50.0), "b2": (1, 0, 7, 10.0),
    "A1": (0, 5, 11, 10.0), "a1": (1, 0, 3, 10.0), "A2": (7, 0, 13, 20.0), "a2": (0, 0, 3, 10.0),
    "F1": (3, 5, 23, 60.0), "f1": (1, 0, 4, 10.0), "F2": (9, 0, 17, 40.0), "f2": (0, 0, 5, 10.0),
}


def rule_array(name: str, shape: tuple) -> np.ndarray:
    a, b, m, scale = RULES[name]
    if len(shape) == 1:
        i = np.arange(shape[0])
        return (((a * i) % m) - m // 2) / scale
    i = np.arange(shape[0])[:, None]
    j = np.arange(shape[1])[None, :]
    return (((a * i + b * j) % m) - m // 2) / scale


def random_weights(cfg: ScorerConfig, seed: int = 0) -> Weights:
    """Glorot-uniform matrices, zero biases."""
    rng = np.random.default_rng(seed)
    w = {}
    for name, shape in _shapes(cfg).items():
        if len(shape) == 2:
            lim = np.sqrt(6.0 / (shape[0] + shape[1]))
            w[name] = rng.uniform(-lim, lim, size=shape)
        else:
            w[name] = np.zeros(shape)
    return Weights(w)


# ---------------------------------------------------------------- numpy core

def dropout_mask(row_hash: np.ndarray, units: int, step: int, keep_prob: float) -> np.ndarray:
    """Keep mask scaled by 1/keep_prob; a function of (row key, unit, step) only,
    so a re-run task draws the same mask (M9). The bits are those of
    :func:`dropout_kept`."""
    from epiframe.functions.random import draw32_array, keep_threshold

    return (draw32_array(row_hash, units, step) < np.uint64(keep_threshold(keep_prob))) / keep_prob


def dropout_kept(df: DataFrame, keys: Sequence[str], units: int, steps: Sequence[int],
                 keep_prob: float = KEEP_PROB, seed: int = 0) -> DataFrame:
    """The dropout mask as rows: (keys, unit, step, kept) of every row of ``df``.

    JVM arithmetic on a hash of the keys (:mod:`epiframe.functions.random`), so the mask
    that a fit draws in NumPy can be looked at, or joined to the examples, in SQL."""
    from epiframe.functions.random import draw32, keep_threshold, row_state
    from epiframe.operators.sampling import key_hash60

    rows = df.select(*keys, key_hash60(keys, seed).alias("_h"),
                     F.explode(F.array(*[F.lit(int(t)) for t in steps])).alias("step"))
    drawn = rows.select(*keys, "step", row_state(F.col("_h"), F.col("step")).alias("_state"),
                        F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    kept = draw32(F.col("_state"), F.col("unit")) < F.lit(keep_threshold(keep_prob))
    return drawn.select(*keys, "unit", "step", kept.alias("kept"))


def _one_hot_dense(codes: np.ndarray, depth: int) -> np.ndarray:
    """codes (N, L) -> one_hot(codes, depth) flattened to (N, L*depth); an
    out-of-range code gives a zero row. Used as a BLAS operand both ways."""
    n, length = codes.shape
    out = np.zeros((n, length * depth))
    ok = (codes >= 0) & (codes < depth)
    rows, pos = np.nonzero(ok)
    out[rows, pos * depth + codes[rows, pos]] = 1.0
    return out


def _counts(alleles: np.ndarray, categories: int) -> np.ndarray:
    n = alleles.shape[0]
    cnt = np.zeros((n, categories))
    for s in range(alleles.shape[1]):
        c = alleles[:, s]
        ok = (c >= 1) & (c <= categories)
        np.add.at(cnt, (np.nonzero(ok)[0], c[ok] - 1), 1.0)
    return cnt


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def split_vectors(vecs: np.ndarray, cfg: ScorerConfig):
    """(N, width) -> peptide codes, allele codes, abundance, flank codes."""
    pep = np.rint(vecs[:, :PEPTIDE]).astype(np.int64)
    al = np.rint(vecs[:, PEPTIDE:PEPTIDE + ALLELES]).astype(np.int64)
    ab = vecs[:, PEPTIDE + ALLELES:PEPTIDE + ALLELES + 1] if cfg.spec["abundance"] else None
    fl = (np.rint(vecs[:, PEPTIDE + ALLELES + 1:PEPTIDE + ALLELES + 1 + FLANK]).astype(np.int64)
          if cfg.spec["flank"] else None)
    return pep, al, ab, fl


def forward(w: Weights, vecs: np.ndarray, cfg: ScorerConfig, mask: np.ndarray | None = None):
    """Score a batch; returns (score, cache for backward)."""
    W = w.arrays
    pep, al, ab, fl = split_vectors(vecs, cfg)
    X1 = _one_hot_dense(pep, cfg.depth)
    pre = X1 @ W["W1"] + W["b1"]
    h = np.maximum(pre, 0.0)
    if mask is not None:
        h = h * mask
    z = h @ W["W2"] + W["b2"]
    cache = {"X1": X1, "pre": pre, "h": h, "mask": mask}
    if ab is not None:
        apre = ab @ W["A1"] + W["a1"]
        ah = np.maximum(apre, 0.0)
        z = z + (ah @ W["A2"] + W["a2"])
        cache.update(ab=ab, apre=apre, ah=ah)
    if fl is not None:
        XF = _one_hot_dense(fl, cfg.depth)
        fpre = XF @ W["F1"] + W["f1"]
        fh = np.maximum(fpre, 0.0)
        z = z + (fh @ W["F2"] + W["f2"])
        cache.update(XF=XF, fpre=fpre, fh=fh)
    cnt = _counts(al, cfg.categories)
    sz = _sigmoid(z)
    score = (sz * cnt).sum(axis=1)
    cache.update(cnt=cnt, sz=sz)
    return score, cache


def log_loss_terms(y: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s)))


def backward(w: Weights, cache: dict, y: np.ndarray, s: np.ndarray, cfg: ScorerConfig) -> dict:
    """Gradient of the summed log loss over the batch (M8)."""
    W = w.arrays
    ds = _sigmoid(s) - y                                     # (N,)
    G = ds[:, None] * cache["cnt"] * cache["sz"] * (1.0 - cache["sz"])   # dL/dz (N, C)
    g = {"W2": cache["h"].T @ G, "b2": G.sum(axis=0)}
    dh = G @ W["W2"].T
    if cache["mask"] is not None:
        dh = dh * cache["mask"]
    dpre = dh * (cache["pre"] > 0)
    g["b1"] = dpre.sum(axis=0)
    g["W1"] = cache["X1"].T @ dpre
    dz_extra = G.sum(axis=1, keepdims=True)                 # (N, 1)
    if "ab" in cache:
        g["A2"] = cache["ah"].T @ dz_extra
        g["a2"] = dz_extra.sum(axis=0)
        dapre = (dz_extra @ W["A2"].T) * (cache["apre"] > 0)
        g["A1"] = cache["ab"].T @ dapre
        g["a1"] = dapre.sum(axis=0)
    if "XF" in cache:
        g["F2"] = cache["fh"].T @ dz_extra
        g["f2"] = dz_extra.sum(axis=0)
        dfpre = (dz_extra @ W["F2"].T) * (cache["fpre"] > 0)
        g["F1"] = cache["XF"].T @ dfpre
        g["f1"] = dfpre.sum(axis=0)
    return g


def _arrow_vectors(batch, col: str) -> np.ndarray:
    """Fixed-width list column of an Arrow batch -> (N, width) float64, without
    a Python loop over rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = batch.column(col)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    if arr.null_count:
        raise ValueError(f"NULL example vector in column {col!r}")
    sizes = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError("example vectors of different widths in one batch")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, int(sizes[0]))


# ------------------------------------------------------------- Spark operators

def score_examples(df: DataFrame, weights: Weights, cfg: ScorerConfig | None = None,
                   vec: str = "vec", out: str = "score", rebalance: bool = True) -> DataFrame:
    """Add ``score`` (M6) to every example row; all other columns pass through.

    One ``mapInArrow`` over Arrow batches. The model math is the costly step, and
    rows made by exploding texts are spread very unevenly over the input splits,
    so by default the (narrow) example rows are rebalanced first: AQE cuts them
    into even partitions of the advisory size.
    """
    from epiframe.session import ship_package

    ship_package(df.sparkSession)
    cfg = cfg or ScorerConfig()
    w = weights

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = _arrow_vectors(rb, vec)
            if X.shape[1] != cfg.width:
                raise ValueError(f"example width {X.shape[1]} != {cfg.width}")
            s, _ = forward(w, X, cfg)
            yield rb.append_column(out, pa.array(s, type=pa.float64()))

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    src = df.hint("rebalance") if rebalance else df
    return src.mapInArrow(run, schema)


def linear_layer(df: DataFrame, in_col: str, W: np.ndarray, b: np.ndarray,
                 activation: str | None = None, out: str = "y") -> DataFrame:
    """Affine map of a numeric vector column (M1), optional relu/sigmoid (M2),
    as ARRAY<DOUBLE>, computed in NumPy on Arrow batches (for wide layers; small
    ones are JVM expressions, see :func:`epiframe.functions.linear.affine`)."""
    from epiframe.session import ship_package

    ship_package(df.sparkSession)
    W, b = np.asarray(W, dtype=np.float64), np.asarray(b, dtype=np.float64)
    n_out = W.shape[1]

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = _arrow_vectors(rb, in_col)
            Y = X @ W + b
            if activation == "relu":
                Y = np.maximum(Y, 0.0)
            elif activation == "sigmoid":
                Y = _sigmoid(Y)
            offsets = pa.array(np.arange(0, (rb.num_rows + 1) * n_out, n_out, dtype=np.int32))
            col = pa.ListArray.from_arrays(offsets, pa.array(Y.ravel(), type=pa.float64()))
            yield rb.append_column(out, col)

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


SLICE = 4096    # parameters of one slice of the gradient
FAN_IN = 32     # partial sums a slice is dealt into before its last sum


def gradient_sums(df: DataFrame, weights: Weights, cfg: ScorerConfig | None = None,
                    vec: str = "vec", label: str = "label", step: int | None = None,
                    key_hash: str | None = None, slice_size: int = SLICE, fan_in: int = FAN_IN) -> DataFrame:
    """Summed loss gradient over all rows (M8) as rows ``(slice, g)``: slice ``s`` holds
    parameters ``s * slice_size ..`` in sorted name order, slice -1 (rows, summed loss).

    Reduce-scatter: each task adds its batches in NumPy and emits its sum in slices; the
    slices of a group of tasks are added first, then those of all groups, so every
    reducer adds slices, never whole models, however many tasks and parameters there are.
    The sums are Spark ML's ``Summarizer``. With ``step`` and ``key_hash`` (a BIGINT
    column), dropout is applied (M9).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from epiframe.session import ship_package

    ship_package(df.sparkSession)
    cfg = cfg or ScorerConfig()
    w = weights
    names = sorted(w.arrays)
    cols = [vec, label] + ([key_hash] if key_hash else [])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        loss, rows = 0.0, 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = _arrow_vectors(rb, vec)
            y = rb.column(label).to_numpy(zero_copy_only=False).astype(np.float64)
            kh = rb.column(key_hash).to_numpy(zero_copy_only=False) if key_hash else None
            v, part_loss = batch_gradient(w, X, y, cfg, names, step, kh)
            total = v if total is None else total + v
            loss += part_loss
            rows += rb.num_rows
        if total is None:
            return
        cuts = [total[i:i + slice_size] for i in range(0, total.size, slice_size)]
        group = TaskContext.get().partitionId() % fan_in
        values = [np.array([rows, loss]), *cuts]
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(cuts), dtype=np.int32)), pa.array(np.full(len(values), group, np.int32)),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))],
            names=["slice", "part", "g"])

    parts = df.select(*cols).mapInArrow(run, "slice int, part int, g array<double>")
    some = parts.groupBy("slice", "part").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    return some.groupBy("slice").agg(vector_to_array(Summarizer.sum(F.col("g"))).alias("g"))


def batch_gradient(w: Weights, X: np.ndarray, y: np.ndarray, cfg: ScorerConfig, names: Sequence[str],
                   step: int | None = None, key_hash: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(flat gradient sum, loss sum) of one batch of example vectors."""
    mask = None
    if step is not None and key_hash is not None:
        mask = dropout_mask(key_hash.astype(np.int64), cfg.hidden, step, cfg.keep_prob)
    s, cache = forward(w, X, cfg, mask)
    g = backward(w, cache, y, s, cfg)
    return np.concatenate([g[k].ravel() for k in names]), float(log_loss_terms(y, s).sum())


def collect_gradient(slices: DataFrame, weights: Weights) -> tuple[Weights, float, int]:
    """Bring the (model-sized) summed gradient to the driver."""
    got = {r["slice"]: r["g"] for r in slices.collect()}  # model-sized
    if not got:
        return weights.unflat(np.zeros(weights.flat().size)), 0.0, 0
    rows, loss = got.pop(-1)
    return weights.unflat(np.concatenate([got[i] for i in sorted(got)])), float(loss), int(rows)


def gradient_components(slices: DataFrame, weights: Weights, slice_size: int = SLICE) -> DataFrame:
    """(name, i, j, g): every component of the gradient as a row; a vector has j = 0."""
    flat = slices.where("slice >= 0").select(F.col("slice").cast("long").alias("s"), F.posexplode("g").alias("p", "g")) \
        .select((F.col("s") * slice_size + F.col("p")).alias("at"), "g")
    name, first, width, at = F.lit(None).cast("string"), F.lit(0), F.lit(1), 0
    for k in sorted(weights.arrays):
        shape = weights.arrays[k].shape
        here = F.col("at") >= at
        name = F.when(here, F.lit(k)).otherwise(name)
        first = F.when(here, F.lit(at)).otherwise(first)
        width = F.when(here, F.lit(shape[1] if len(shape) > 1 else 1)).otherwise(width)
        at += weights.arrays[k].size
    named = flat.select(name.alias("name"), (F.col("at") - first).alias("o"), width.alias("w"), "g")
    return named.select("name", F.expr("cast(o div w as int)").alias("i"), F.expr("cast(o % w as int)").alias("j"), "g")


@dataclass
class AdamState:
    m: np.ndarray
    v: np.ndarray
    t: int = 0


def adam_update(w: Weights, g: Weights, state: AdamState, lr: float = 1e-3,
                b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Weights:
    """One Adam step (Kingma and Ba, 2015) on the flat parameter vector."""
    x, gv = w.flat(), g.flat()
    state.t += 1
    state.m = b1 * state.m + (1 - b1) * gv
    state.v = b2 * state.v + (1 - b2) * gv * gv
    mh = state.m / (1 - b1 ** state.t)
    vh = state.v / (1 - b2 ** state.t)
    return w.unflat(x - lr * mh / (np.sqrt(vh) + eps))


def fit_scorer(df: DataFrame, cfg: ScorerConfig | None = None, steps: int = 5,
               lr: float = 1e-2, seed: int = 0, vec: str = "vec", label: str = "label",
               keys: Sequence[str] = (), dropout: bool = True,
               init: Weights | None = None,
               batch_col: str | None = None, save_path: str | None = None,
               save_every: int = 1) -> tuple[Weights, list[tuple[int, float, int]]]:
    """Synchronous data-parallel Adam (M7): each step is one Spark job computing
    the mean gradient of the log loss, then one Adam update on the driver.

    Without ``batch_col`` every step uses all of ``df`` (full-batch). With it
    (for example the ``batch`` column of
    :func:`epiframe.operators.batching.balanced_batches`, n rows of each class
    per batch), step ``t`` uses batch ``t mod n_batches``, as the reference's
    trainer draws one balanced batch per step. Returns the weights and
    (step, mean loss, rows) per step.

    With ``save_path`` (shared storage, e.g. below ``spark.checkpoint.dir``) the
    weights and optimiser state are written every ``save_every`` steps, and a
    later call with the same path resumes after the last saved step.
    """
    cfg = cfg or ScorerConfig()
    w = init.copy() if init is not None else random_weights(cfg, seed)
    state = AdamState(np.zeros_like(w.flat()), np.zeros_like(w.flat()))
    first = 0
    if save_path is not None:
        saved = load_state(df.sparkSession, save_path, w)
        if saved is not None:
            w, state, first = saved
    data = df
    key_hash = None
    if dropout and keys:
        from epiframe.operators.sampling import key_hash60

        data = df.withColumn("_kh", key_hash60(keys, seed))
        key_hash = "_kh"
    n_batches = None
    if batch_col is not None:
        # The batch table is written once, range-partitioned and sorted on the
        # batch, to the shared checkpoint folder: a step's ``batch = t`` filter
        # is pushed to the Parquet scan and skips the other files and row
        # groups instead of reading the whole table each step.
        from epiframe.session import scratch_path

        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        path = scratch_path(spark, "fit-batches")
        (data.repartitionByRange(parts, batch_col).sortWithinPartitions(batch_col)
         .write.parquet(path))
        data = spark.read.parquet(path)
        n_batches = int(data.agg(F.max(batch_col)).first()[0]) + 1
    history = []
    for step in range(first, steps):
        part = data if n_batches is None else data.filter(F.col(batch_col) == step % n_batches)
        slices = gradient_sums(part, w, cfg, vec, label,
                                 step=step if key_hash else None, key_hash=key_hash)
        g, loss, rows = collect_gradient(slices, w)
        if rows == 0:
            break
        g = g.unflat(g.flat() / rows)
        history.append((step, loss / rows, rows))
        w = adam_update(w, g, state, lr)
        if save_path is not None and ((step + 1) % save_every == 0 or step + 1 == steps):
            save_state(df.sparkSession, save_path, w, state, step + 1)
    return w, history


def save_state(spark, path: str, w: Weights, state: AdamState, next_step: int) -> None:
    """Weights + Adam moments as one small Parquet table (one row per tensor)."""
    rows = [(k, list(map(int, a.shape)), a.ravel().tolist()) for k, a in w.arrays.items()]
    rows += [("__m", [state.m.size], state.m.tolist()), ("__v", [state.v.size], state.v.tolist()),
             ("__step", [2], [float(next_step), float(state.t)])]
    df = spark.createDataFrame(rows, "name string, shape array<int>, value array<double>")
    # a folder per step; Spark marks it with _SUCCESS when it is whole
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/step={next_step:012d}")


def load_state(spark, path: str, like: Weights):
    """(weights, state, next_step) of the last whole :func:`save_state`, or None if
    nothing was saved. A state that cannot be read is an error."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    steps = [str(f.getPath().getName()) for f in fs.listStatus(base)]
    whole = [s for s in steps if s.startswith("step=")
             and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{s}/_SUCCESS"))]
    if not whole:
        return None
    rows = {r["name"]: r for r in spark.read.parquet(f"{path}/{max(whole)}").collect()}  # one row per tensor
    arrays = {k: np.asarray(rows[k]["value"], dtype=np.float64).reshape(like.arrays[k].shape)
              for k in like.arrays}
    step, t = rows["__step"]["value"]
    state = AdamState(np.asarray(rows["__m"]["value"]), np.asarray(rows["__v"]["value"]), int(t))
    return Weights(arrays), state, int(step)
