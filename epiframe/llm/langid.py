"""Operator 1: language of a text by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (a space on either side), one GRU in each
direction, and labels every byte position with language probabilities. A
document's probabilities are the mean over the positions of all its words that
hold a letter. Training is backpropagation through time in numpy on the driver,
on a bounded sample of words of labelled documents; prediction covers whole texts, and
equal words are run through the network once per worker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.llm.common import prepare_python, table

HIDDEN = 16
PIECE = 30                   # bytes of a network sequence; longer words are cut
SAMPLE_DOCS = 150            # labelled documents per language used to train
DOC_WORDS = 400              # words drawn from a sampled document, from all over its text
SAMPLE_WORDS = 8_000         # words per language drawn from the sample
STEPS, BATCH, RATE, SEED = 700, 256, 0.01, 5
MAX_WORDS = 300_000          # words remembered per worker
UNKNOWN = "und"

_WORD = re.compile("[^\x20\x09-\x0d]+")
_LETTER = re.compile(r"[^\W\d_]")
_STATE: dict = {}


class BiGru:
    """Weights and the numpy forward and backward passes (float32)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        import numpy as np
        rng = np.random.default_rng(seed)
        self.langs = langs
        h, k = hidden, len(langs)

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w: dict = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = (rng.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)
            self.w[f"h{d}"] = init(h, 3 * h)
            self.w[f"c{d}"] = np.zeros(3 * h, np.float32)
        self.w["o"] = init(2 * h, k)
        self.w["p"] = np.zeros(k, np.float32)
        self.hidden = h

    def _run(self, d: str, x, mask, keep: list | None = None):
        """States (time, batch, hidden) of one direction."""
        import numpy as np
        h, wx, wh, c = self.hidden, self.w[f"x{d}"], self.w[f"h{d}"], self.w[f"c{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]):
            pre = wx[x[t]]
            rec = state @ wh + c
            zr = 1.0 / (1.0 + np.exp(-(pre[:, :2 * h] + rec[:, :2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(pre[:, 2 * h:] + r * rec[:, 2 * h:])
            new = n + z * (state - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((state, z, r, n, rec[:, 2 * h:], m))
            state = np.where(m, new, state)
            out[t] = state
        return out

    def _back(self, d: str, x, kept: list, dout, grads: dict):
        """Backpropagation through time of one direction."""
        import numpy as np
        h, wh = self.hidden, self.w[f"h{d}"]
        gh, gc = np.zeros_like(wh), np.zeros(3 * h, np.float32)
        dpre = np.empty((*x.shape, 3 * h), np.float32)
        dstate = np.zeros((x.shape[1], h), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            state, z, r, n, rn, m = kept[t]
            total = dstate + dout[t]
            live = np.where(m, total, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (state - n) * z * (1 - z)
            dr = dn * rn * r * (1 - r)
            drec = np.concatenate([dz, dr, dn * r], 1)
            gh += state.T @ drec
            gc += drec.sum(0)
            dpre[t] = np.concatenate([dz, dr, dn], 1)
            dstate = np.where(m, live * z, total) + drec @ wh.T
        gx = np.zeros((256, 3 * h), np.float32)
        flat, rows = x.ravel(), dpre.reshape(-1, 3 * h)
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        gx[flat[order][at]] = np.add.reduceat(rows[order], at)
        grads[f"x{d}"], grads[f"h{d}"], grads[f"c{d}"] = gx, gh, gc

    def _both(self, words: list[bytes], keep=None):
        """Position logits (time, batch, langs) and the mask of real positions."""
        import numpy as np
        n = [len(w) + 2 for w in words]
        steps = max(n)
        x = np.frombuffer(b"".join((b" " + w + b" ").ljust(steps, b" ") for w in words), np.uint8) \
            .reshape(len(words), steps).T.astype(np.int64)
        length = np.array(n)
        at = np.arange(steps)[:, None]
        mask = at < length
        back = np.where(mask, length - 1 - at, at)  # own inverse
        col = np.arange(len(words))
        xr = x[back, col]
        kf, kb = (keep if keep is not None else (None, None))
        hf = self._run("f", x, mask, kf)
        hb = self._run("b", xr, mask, kb)[back, col]
        hid = np.concatenate([hf, hb], 2)
        inside = mask & (at > 0) & (at < length - 1)
        return x, xr, back, col, hid, hid @ self.w["o"] + self.w["p"], inside

    @staticmethod
    def _softmax(a):
        import numpy as np
        e = np.exp(a - a.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def gradients(self, words: list[bytes], labels) -> tuple[float, dict]:
        """Mean cross-entropy over positions and its gradients."""
        import numpy as np
        kf, kb = [], []
        x, xr, back, col, hid, logits, inside = self._both(words, (kf, kb))
        p = self._softmax(logits)
        total = inside.sum()
        y = np.broadcast_to(labels, inside.shape)
        loss = -np.log(np.take_along_axis(p, y[..., None], 2)[..., 0][inside] + 1e-12).mean()
        d = p.copy()
        np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) - 1, 2)
        d *= inside[..., None] / np.float32(total)
        d = d.astype(np.float32)
        grads = {"o": hid.reshape(-1, hid.shape[2]).T @ d.reshape(-1, d.shape[2]), "p": d.sum((0, 1))}
        dh = d @ self.w["o"].T
        h = self.hidden
        self._back("f", x, kf, dh[..., :h], grads)
        self._back("b", xr, kb, dh[..., h:][back, col], grads)
        return float(loss), grads

    def position_sums(self, words: list[bytes]):
        """Sum of position probabilities per word, shape (words, langs)."""
        import numpy as np
        out = np.zeros((len(words), len(self.langs)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 2048):
            part = order[at:at + 2048]
            *_, logits, inside = self._both([words[i] for i in part])
            out[part] = (self._softmax(logits) * inside[..., None]).sum(0)
        return out


def pieces_of(word: str) -> list[bytes]:
    """The word's bytes in pieces of at most PIECE bytes, cut between characters."""
    b = word.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(b):
        end = min(at + PIECE, len(b))
        while end < len(b) and b[end] & 0xC0 == 0x80:
            end -= 1
        out.append(b[at:end])
        at = end
    return out


def train(samples: dict[str, list[str]], steps: int = STEPS, seed: int = SEED) -> BiGru | None:
    """Adam on minibatches of words drawn evenly from the languages."""
    import numpy as np
    rng = np.random.default_rng(seed)
    pools: dict[str, list[bytes]] = {}
    for lang in sorted(samples):
        words = [p for t in samples[lang] for w in _WORD.findall(t) if _LETTER.search(w) for p in pieces_of(w)]
        if words:
            pick = rng.choice(len(words), min(SAMPLE_WORDS, len(words)), replace=False)
            pools[lang] = [words[i] for i in pick]
    if not pools:
        return None
    net = BiGru(list(pools), seed=seed)
    flat = [(w, i) for i, lang in enumerate(net.langs) for w in pools[lang]]
    share = np.concatenate([np.full(len(pools[k]), 1 / len(pools[k]) / len(pools)) for k in net.langs])
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        batch = [flat[i] for i in rng.choice(len(flat), BATCH, p=share)]
        _, grads = net.gradients([b[0] for b in batch], np.array([b[1] for b in batch]))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.999 * v2[k] + 0.001 * g * g
            net.w[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    """crc32 of the id's text modulo 5 is 0 (NULL id: false)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS,
                    words: int = DOC_WORDS) -> dict[str, list[str]]:
    """Words of at most ``docs_per_language`` texts of each language, chosen by a hash of
    the id, never from the held-out fold; one string per text. Texts of every length take
    part: each gives at most ``words`` words, drawn by hash from all over it (runs of over
    PIECE characters are drawn in pieces), so what reaches the driver is bounded."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                      & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    keys = rows.select("lang", "doc_id", F.xxhash64(F.lit(SEED), "doc_id").alias("h"))
    pick = keys.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))) \
        .where(F.col("rn") <= docs_per_language).select(F.col("doc_id").alias("_i"))
    runs = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]{1,%d}" % PIECE), F.lit(0))
    drawn = F.slice(F.array_sort(F.transform(runs, lambda w, i: F.struct(F.xxhash64(F.lit(SEED), i, w), w.alias("w")))), 1, words)
    got = rows.join(F.broadcast(pick.distinct()), F.col("doc_id") == F.col("_i")) \
        .select("lang", "doc_id", F.array_join(F.transform(drawn, lambda d: d["w"]), " ").alias("text")) \
        .orderBy("lang", "doc_id", "text").collect()
    out: dict[str, list[str]] = {}
    for r in got:
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, net: BiGru | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. ``und`` with score 0 for NULL texts and
    texts without a letter (and for all texts when nothing could be learned); ties go
    to the language that sorts first. Other columns are ignored."""
    spark = docs.sparkSession
    prepare_python(spark)
    held = spark.sparkContext.broadcast(net)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        net = held.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 512):
                part = texts.slice(at, 512).to_pylist()
                pred, score = _predict(net, part)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                                 names=["_id", "lang_pred", "score"])

    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _predict(net: BiGru | None, texts: list) -> tuple[list[str], list[float]]:
    import numpy as np
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    key = (tuple(net.langs), net.w["o"].tobytes())
    if _STATE.get("key") != key or len(_STATE["index"]) > MAX_WORDS:
        # words of another model, or too many: start anew
        _STATE.update(key=key, index={}, sums=np.zeros((0, len(net.langs) + 1), np.float32))
    index: dict[str, int] = _STATE["index"]
    words = [_WORD.findall(t) if t else [] for t in texts]
    new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in index]
    if new:
        # per word: summed position probabilities and number of positions; words
        # without a letter take no part
        sums = np.zeros((len(new), len(net.langs) + 1), np.float32)
        owner, cut = [], []
        for i, w in enumerate(new):
            if _LETTER.search(w):
                for p in pieces_of(w):
                    owner.append(i)
                    cut.append(p)
        if cut:
            got = net.position_sums(cut)
            np.add.at(sums, np.array(owner), np.column_stack([got, [len(c) for c in cut]]).astype(np.float32))
        start = len(index)
        index.update((w, start + i) for i, w in enumerate(new))
        _STATE["sums"] = np.concatenate([_STATE["sums"], sums])
    table_ = _STATE["sums"]
    pred, score = [], []
    for ws in words:
        total = table_[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64) if ws else None
        if total is None or total[-1] == 0:
            pred.append(UNKNOWN)
            score.append(0.0)
        else:
            p = total[:-1] / total[-1]
            best = int(p.argmax())
            pred.append(net.langs[best])
            score.append(float(min(1.0, p[best])))
    return pred, score


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(training_sample(docs))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
