"""Operator 5: near duplicates by improved consistent weighted sampling (ICWS).

Documents are weighted sets of five-word shingles, weight = count x IDF. Document
frequencies are counted in 2^20 hashed counters over every document of the corpus, copies
too, less what other shingles add to a counter on average; a shingle below ``rare``
documents weighs 1, more frequent ones less (a shingle that shares a counter with a
frequent one weighs as that one does, in every document).

Each document gets ICWS samples (Ioffe, 2010), banded into keys. Documents with a
common key whose one-bit sketches of all samples agree are compared by weighted Jaccard
similarity, and documents of at least ``threshold`` are linked; classes are the
connected components. Inside a key, all pairs are never formed: members are compared
with a few leaders, linked members share a component, and only members still in
different components go on. Leaders are the texts that meet most others over all their
keys, so a group of edited copies is led by the text nearest to what they have in
common, and not by one that is far from most. What the first leaders leave is keyed by
prefixes (the rarest shingles that hold over 1 - ``threshold`` of a text's weight, which
texts of at least ``threshold`` must share); a common shingle makes a pair only if what
either text holds from there on is enough for the threshold. These go to further
leaders, until no key holds two components whose members have not been compared.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, prepare_python, table
from epiframe.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6            # P(no common band) = 6e-5 at similarity 0.8
SAMPLES = BANDS * ROWS         # a multiple of 64: one sketch bit a sample
DEVIATIONS = 4                 # P(sketches differ too much) = 3e-5 at the threshold
TABLE_BITS = 14                # rows of the table of random variates
SKETCH_BITS = 20               # hashed counters of document frequency
RARE_SHARE, RARE_LEAST = 1000, 32
SKETCH_BLOCK = 1 << 14
SKETCH_TASKS = 256             # tasks whose counters are summed in one group (16 MB)
SEED = 0x5EED
TEXT_ROWS, VECTOR_ROWS = 1000, 500  # rows with texts or packed vectors in one Arrow batch
TEXT_BLOCK = 1 << 18           # bytes whose words are hashed at once
MAX_BROADCAST_BYTES = 16 << 20  # of vectors, measured; beyond it pairs are joined by shuffles
MAX_BROADCAST_IDS = 1_000_000  # 8 MB of ids; beyond it a shuffle join fetches the texts

_STATE: dict = {}


def mix64(x):
    """splitmix64 finaliser on uint64 arrays."""
    import numpy as np
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def _powers(n):
    """Powers of an odd base modulo 2^64 and their inverses, at least ``n`` of each."""
    import numpy as np
    if len(_STATE.get("powers", ((),))[0]) < n:
        base = 0x9E3779B97F4A7C15
        n = max(n, TEXT_BLOCK)
        _STATE["powers"] = tuple(np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    return _STATE["powers"]


def _block_hashes(b):
    """Hashes of the words of a run of bytes: every word's polynomial over a random
    value per byte, read off one running sum."""
    import numpy as np
    if "values" not in _STATE:
        _STATE["values"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _STATE["inside"] = np.ones(256, bool)
        _STATE["inside"][[9, 10, 11, 12, 13, 32]] = False
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _STATE["inside"][b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    terms = _STATE["values"][b]
    terms *= power[:len(b)]
    np.cumsum(terms, out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start])


def word_hashes(text: str):
    """64-bit hashes of the words, in order. Texts are hashed in blocks that end at
    white space (a longer word is a block of its own)."""
    import numpy as np
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) <= TEXT_BLOCK:
        return _block_hashes(b)
    out, at = [], 0
    while at < len(b):
        size = TEXT_BLOCK
        while at + size < len(b):
            space = np.flatnonzero((b[at:at + size] == 32) | (b[at:at + size] - np.uint8(9) < 5))
            if len(space):
                size = int(space[-1]) + 1
                break
            size *= 2
        out.append(_block_hashes(b[at:at + size]))
        at += size
    return np.concatenate(out)


def shingles(h):
    """64-bit hashes of the five-word shingles of hashed words, in order (with
    repeats). A text of one to four words is one shingle; one without words has none."""
    import numpy as np
    n = len(h)
    if n == 0:
        return h
    k = min(n, SHINGLE)
    out = h[:n - k + 1].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i:n - k + 1 + i]
    return mix64(out)


class Idf:
    """Weights by counter (ascending counter numbers); every other counter weighs 1."""

    def __init__(self, frequent, weights):
        self.frequent, self.weights = frequent, weights

    def vector(self, h):
        """(distinct shingles ascending, weights) of hashed words."""
        import numpy as np
        s, tf = np.unique(shingles(h), return_counts=True)
        w = tf.astype(np.float64)
        if len(self.frequent) and len(s):
            counter = s >> np.uint64(64 - SKETCH_BITS)
            at = np.minimum(np.searchsorted(self.frequent, counter), len(self.frequent) - 1)
            hit = self.frequent[at] == counter
            w[hit] *= self.weights[at[hit]]
        return s, w


def variates():
    """r, ln c (both from Gamma(2, 1)) and beta of every table row and sample (float32),
    the rows' ranks by ln a at weight 1, and by rank the rows and their ln a; made once
    per worker."""
    import numpy as np
    if "variates" not in _STATE:
        n, k = 1 << TABLE_BITS, SAMPLES
        r, lnc, beta, value = (np.empty((n, k), np.float32) for _ in range(4))
        for at in range(0, n, 1024):
            base = np.arange(at * k, (at + 1024) * k, dtype=np.uint64).reshape(1024, k)

            def u(i):
                x = mix64(base * np.uint64(5) + np.uint64((i + SEED * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
                return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            r[at:at + 1024] = -np.log(u(0) * u(1))
            lnc[at:at + 1024] = np.log(-np.log(u(2) * u(3)))
            beta[at:at + 1024] = u(4)
        value[:] = lnc - r * (np.float32(0) - beta) - r
        rank, order = (np.empty((n, k), np.uint16) for _ in range(2))
        for j in range(k):
            order[:, j] = np.argsort(value[:, j], kind="stable")
            rank[order[:, j], j] = np.arange(n, dtype=np.uint16)
            value[:, j] = value[order[:, j], j]
        _STATE["variates"] = r, lnc, beta, rank, order, value
    return _STATE["variates"]


def samples(s, w):
    """The ICWS samples of a weighted shingle set (ascending shingles), hashed. Variates
    are drawn per table row, chosen by the top bits of the shingle; equal ln a go to the
    lesser shingle, and a sample is known by its shingle and ln a."""
    import numpy as np
    r, lnc, beta, rank, order, value = variates()
    column = np.arange(SAMPLES)
    shift = np.uint64(64 - TABLE_BITS)
    plain = w == 1.0
    least = np.full(SAMPLES, np.inf, np.float32)
    who = np.zeros(SAMPLES, np.uint64)
    ordinary = s[plain]
    if len(ordinary):
        rows = (ordinary >> shift).astype(np.int64)
        rows = rows[np.concatenate(([True], rows[1:] != rows[:-1]))]
        top = np.full(SAMPLES, (1 << TABLE_BITS) - 1, np.uint16)
        for at in range(0, len(rows), 1024):
            top = np.minimum(top, rank[rows[at:at + 1024]].min(0))
        least = value[top, column]
        who = ordinary[np.searchsorted(ordinary, order[top, column].astype(np.uint64) << shift)]
    odd = np.flatnonzero(~plain)
    for at in range(0, len(odd), 1024):
        x = s[odd[at:at + 1024]]
        i = (x >> shift).astype(np.int64)
        t = np.floor(np.log(w[odd[at:at + 1024]]).astype(np.float32)[:, None] / r[i] + beta[i])
        ln_a = lnc[i] - r[i] * (t - beta[i]) - r[i]
        first = ln_a.argmin(0)
        low = ln_a[first, column]
        better = (low < least) | ((low == least) & (x[first] < who))
        least, who = np.where(better, low, least), np.where(better, x[first], who)
    return mix64(who ^ mix64(least.view(np.uint32).astype(np.uint64) + column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def band_keys(x):
    """Band keys (int64) of hashed samples, one row of samples a document."""
    import numpy as np
    x = x.reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + x[:, :, i])
    return out.view(np.int64)


def sketch_bits(x):
    """One bit of every hashed sample, packed in int64 words, one row a document."""
    import numpy as np
    return np.packbits((x & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)


def most_differing(threshold: float) -> int:
    """Sketch bits in which two texts of similarity ``threshold`` may differ: the mean of
    (1 - threshold) / 2 of all bits and ``DEVIATIONS`` standard deviations."""
    p = (1 - threshold) / 2
    return math.ceil(SAMPLES * p + DEVIATIONS * math.sqrt(SAMPLES * p * (1 - p)))


def weighted_jaccard(sa, wa, sb, wb) -> float:
    import numpy as np
    _, i, j = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high > 0 else 0.0


# --- corpus statistics ------------------------------------------------------------

def shingle_counters(texts: DataFrame):
    """2^20 hashed counters (int64) of the texts (column 0) that hold a shingle; 8 MB on
    the driver, whatever the corpus size."""
    import numpy as np

    def sketch(batches):
        import pyarrow as pa
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for t in b.column(0):
                s = np.sort(shingles(word_hashes(t.as_py() or "")))
                if len(s):
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                    np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        for i in range(len(blocks)):
            if blocks[i].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "counts"])

    def add(key, frame, kind):
        import pandas as pd
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for c in frame["counts"]:
            total += np.frombuffer(c, kind)
        return pd.DataFrame({"block": [int(key[0])], "counts": [total.tobytes()]})

    # one row of 64 kB per task and block, summed in two levels, so that no group holds
    # the rows of more than SKETCH_TASKS tasks
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK)
    with _small_batches(texts.sparkSession, TEXT_ROWS):
        parts = texts.mapInArrow(sketch, "block int, counts binary") \
            .withColumn("g", F.floor(F.spark_partition_id() / SKETCH_TASKS).cast("int"))
        sums = parts.groupBy("block", "g").applyInPandas(lambda key, f: add(key, f, np.uint32), "block int, counts binary") \
            .groupBy("block").applyInPandas(lambda key, f: add(key, f, np.int64), "block int, counts binary").collect()
    for r in sums:
        total[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return total.reshape(-1)


def document_frequencies(texts: DataFrame, n_docs: int) -> Idf:
    """IDF weights from counters over ``n_docs`` texts (column 0).

    What the other shingles add to a counter on average is taken off first, so long
    texts, which fill all counters, do not make every shingle frequent. What is left
    estimates the documents of the counter's most frequent shingle: frequent from
    ``n_docs / RARE_SHARE`` documents on, and from ``RARE_LEAST`` on, as a share cannot
    be told from a few documents.
    """
    import numpy as np
    total = shingle_counters(texts)
    found = total - (total.sum() - total) / (len(total) - 1)
    rare = max(RARE_LEAST, math.ceil(n_docs / RARE_SHARE))
    hot = np.flatnonzero(found >= rare)
    top = math.log1p(n_docs / rare)
    return Idf(hot.astype(np.uint64), np.maximum(0.05, np.log1p(n_docs / found[hot]) / top))


# --- links ------------------------------------------------------------------------

def _signatures(docs: DataFrame, idf) -> DataFrame:
    """(id, k1, k2, bands, bits) of every text with a word."""
    words = SAMPLES // 64

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        weights = idf.value
        for b in batches:
            ids, k1, k2, drawn = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                h = word_hashes(t.as_py() or "")
                if not len(h):
                    continue
                x = xxhash.xxh3_128_digest(h.tobytes())
                ids.append(d)
                k1.append(int.from_bytes(x[:8], "little", signed=True))
                k2.append(int.from_bytes(x[8:], "little", signed=True))
                drawn.append(samples(*weights.vector(h)))
            if not ids:
                continue
            x = np.stack(drawn)

            def lists(values, n):
                return pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 lists(band_keys(x), BANDS), lists(sketch_bits(x), words)], names=["id", "k1", "k2", "bands", "bits"])

    with _small_batches(docs.sparkSession, TEXT_ROWS):
        out = docs.mapInArrow(run, "id long, k1 long, k2 long, bands array<long>, bits array<long>")
        return materialise(out.select("id", "k1", "k2", "bands", *[F.col("bits")[i].alias(f"x{i}") for i in range(words)]),
                           "near-signatures")


def _vectors(docs: DataFrame, idf) -> DataFrame:
    """(id, s, w): packed upper halves of the shingles, and the weights other than 1 as
    packed positions followed by values."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        weights = idf.value
        for b in batches:
            ids, ss, ws = b.column(0), [], []
            for t in b.column(1):
                s, w = weights.vector(word_hashes(t.as_py() or ""))
                s = (s >> np.uint64(32)).astype(np.uint32)
                if len(s) and (s[1:] == s[:-1]).any():  # equal upper halves: one entry of both weights
                    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    s, w = s[first], np.add.reduceat(w, first)
                ss.append(s.tobytes())
                odd = np.flatnonzero(w != 1.0)
                ws.append(odd.astype(np.uint32).tobytes() + w[odd].tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(ss, pa.binary()), pa.array(ws, pa.binary())], names=["id", "s", "w"])

    return docs.mapInArrow(run, "id long, s binary, w binary")


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Rows as wide as vectors go to Python a few hundred at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _verify(pairs: DataFrame, docs: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (a, b) of at least ``threshold``, written. Only the texts asked for are read
    into vectors, and those of the b side are shuffled to their leaders."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def vec(s, w):
            s = np.frombuffer(s, np.uint32)
            out, n = np.ones(len(s)), len(w) // 12
            out[np.frombuffer(w, np.uint32, n)] = np.frombuffer(w, np.float64, n, 4 * n)
            return s, out
        for b in batches:
            a, c, sa, wa, sb, wb = (b.column(i) for i in range(6))
            keep = [weighted_jaccard(*vec(sa[i].as_py(), wa[i].as_py()), *vec(sb[i].as_py(), wb[i].as_py())) >= threshold
                    for i in range(b.num_rows)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], names=["a", "b"])

    asked = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-asked")
    if asked.count() <= MAX_BROADCAST_IDS:
        asked = F.broadcast(asked)
    spark = pairs.sparkSession
    with _small_batches(spark, VECTOR_ROWS):
        vectors = materialise(_vectors(docs.join(asked, "id", "left_semi"), idf), "near-vectors")
        left = vectors.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa"))
        right = vectors.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb"))
        size = vectors.agg(F.sum(F.length("s") + F.length("w"))).first()[0] or 0
        if size <= MAX_BROADCAST_BYTES:  # many pairs of few texts: no pair is shuffled with its vectors
            left, right = F.broadcast(left), F.broadcast(right)
            pairs = pairs.repartition("b")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "wa", "sb", "wb")
        return materialise(both.mapInArrow(run, "a long, b long"), "near-links")


def prefix(s, w, counters, threshold):
    """The rarest shingles that hold just over 1 - ``threshold`` of a text's weight, and
    the weight from each of them on. Two texts of at least ``threshold`` share one of
    them: what they have in common weighs at least ``threshold`` of either, so it cannot
    lie in the rest of both."""
    import numpy as np
    if not len(s):
        return s, w
    order = np.lexsort((s, counters[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
    held = np.cumsum(w[order])
    order = order[:1 + int(np.searchsorted(held, (1 - threshold) * held[-1] * (1 + 1e-9), "right"))]
    return s[order], held[-1] - held[:len(order)] + w[order]


def _prefix_buckets(open_docs: DataFrame, docs: DataFrame, idf, threshold: float) -> DataFrame:
    """(k, id, further columns of ``open_docs``, since, weight): the open documents by the
    shingles of their prefixes, rare ones by their number among open documents, with the
    weight from that shingle on and the whole weight. Shingles are left out whose documents
    are all of one component, or all hold too little from there on for a link with a text
    that weighs as much or more."""
    spark = docs.sparkSession
    ids = materialise(open_docs.select("id").distinct(), "near-open")
    texts = docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi")
    counters = spark.sparkContext.broadcast(shingle_counters(texts.select("t")))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        weights, order = idf.value, counters.value
        for b in batches:
            ids, keys, since, whole = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                s, held = prefix(*weights.vector(word_hashes(t.as_py() or "")), order, threshold)
                ids += [d] * len(s)
                keys.append(s)
                since.append(held)
                whole += [float(held[0])] * len(s) if len(s) else []
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(ids, pa.int64()), pa.array(np.concatenate(since) if since else np.zeros(0)),
                 pa.array(whole, pa.float64())], names=["k", "id", "since", "weight"])

    with _small_batches(spark, VECTOR_ROWS):
        keyed = materialise(texts.select("id", "t").mapInArrow(run, "k long, id long, since double, weight double"), "near-prefixes")
    component = open_docs.groupBy("id").agg(F.min("c").alias("c"))
    shared = _open_keys(keyed.join(component, "id"), threshold, True)
    return materialise(keyed.join(shared, "k", "left_semi").join(open_docs, "id")
                       .select("k", *open_docs.columns, "since", "weight"), "near-live")


def _open_keys(live: DataFrame, threshold: float, by_prefix: bool) -> DataFrame:
    """Keys (k) with two components; by prefixes, also with a text that holds enough from
    there on for a link with one that weighs no less."""
    enough = F.col("since") >= _least_common(threshold, F.col("weight"), F.col("weight")) if by_prefix else F.lit(True)
    return live.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(enough).alias("enough")) \
        .where("lo <> hi and enough").select("k")


def _least_common(threshold: float, a, b):
    """What two texts of weights ``a`` and ``b`` must have in common to be linked."""
    return (a + b) * (threshold / (1 + threshold) * (1 - 1e-9))


def link_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(id, class_id) of every row with a non-NULL id; ``class_id`` is the least id of
    the class. Texts without a word are classes of their own, as are ids that only
    occur once in no link. Rows that share an id are one document (their texts, if
    different, link what each links)."""
    spark = docs.sparkSession
    prepare_python(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")
    idf = spark.sparkContext.broadcast(document_frequencies(src.select("t"), src.count()))
    sig = _signatures(src, idf)
    words = [c for c in sig.columns if c.startswith("x")]
    # texts with the same words: one representative each
    reps = sig.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = materialise(sig.select("id", "k1", "k2").join(reps, ["k1", "k2"]).where("id <> rep"), "near-same")
    copies = same.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    later = same.drop("rep")
    # keys are shuffled without the sketches, which only documents with a shared key fetch
    buckets = sig.join(F.broadcast(later) if later.count() <= MAX_BROADCAST_IDS else later, ["id", "k1", "k2"], "left_anti") \
        .select(F.explode("bands").alias("k"), "id", "k1")
    shared = buckets.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    live = materialise(buckets.join(shared, "k"), "near-buckets")
    # how many texts a document meets over all its keys: the first of a key leads it
    met_by = live.groupBy("id").agg(F.sum("n").alias("o"))
    sketches = sig.select("id", "k1", *words).dropDuplicates(["id", "k1"])
    live = materialise(live.join(sketches, ["id", "k1"]).join(met_by, "id")
                       .select("k", "id", *words, "o", F.col("id").alias("c")), "near-live")
    carried, enough = [*words, "o"], F.lit(True)
    differing = sum((F.bit_count(F.col(f"l.{x}").bitwiseXOR(F.col(f"m.{x}"))) for x in words), F.lit(0))
    found = tested = spark.createDataFrame([], "a long, b long")
    leaders, by_prefix = 1, False
    while True:
        rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"), "id"))
        lead = materialise(live.withColumn("rn", rank).where(F.col("rn") <= leaders).drop("rn"), "near-leaders")
        before = (F.col("l.o") > F.col("m.o")) | ((F.col("l.o") == F.col("m.o")) & (F.col("l.id") < F.col("m.id")))
        met = materialise(
            lead.alias("l").join(live.alias("m"), F.col("l.k") == F.col("m.k"))
            .where(before & (F.col("l.c") != F.col("m.c")) & enough)
            .where(differing <= most_differing(threshold))
            .groupBy(F.col("l.id").alias("a"), F.col("m.id").alias("b")).agg(F.count("*").alias("n")), "near-met")
        label = None
        # first every member with the leader it shares most keys with, then what is
        # still in different components
        for best in (True, False):
            if best:
                pairs = met.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("m"))).alias("x")) \
                    .select((-F.col("x.m")).alias("a"), "b")
            else:
                pairs = met.select("a", "b")
            if label is not None:
                ends = [label.select(F.col("v").alias(x), F.col("c").alias("c" + x)) for x in "ab"]
                pairs = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left") \
                    .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
            pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
            if pairs.limit(1).count() == 0:
                continue
            tested = tested.unionByName(pairs)
            links = _verify(pairs, src, idf, threshold)
            if links.limit(1).count() == 0:
                continue
            found = found.unionByName(links)
            label = components(found)
        # leaders have met their whole bucket; what is left matters where components differ
        rest = live.join(lead.select("k", "id"), ["k", "id"], "left_anti")
        if label is not None:
            rest = rest.drop("c").join(label.withColumnRenamed("v", "id"), "id", "left") \
                .select("k", "id", *carried, F.coalesce("c", "id").alias("c"))
        live = materialise(rest.join(_open_keys(rest, threshold, by_prefix), "k", "left_semi").select("k", "id", *carried, "c"), "near-live")
        if live.limit(1).count() == 0:
            break
        if not by_prefix:
            # what one leader a band did not settle is keyed anew: texts that have much in
            # common, but less than the threshold, share few of their rarest shingles
            live, by_prefix = _prefix_buckets(live.select("id", *carried, "c").distinct(), src, idf, threshold), True
            carried += ["since", "weight"]
            enough = F.least("l.since", "m.since") >= _least_common(threshold, F.col("l.weight"), F.col("m.weight"))
            if live.limit(1).count() == 0:
                break
        else:
            leaders *= 32
    comp = components(copies.unionByName(found))
    ids = src.select("id")
    return ids.join(comp, ids["id"] == comp["v"], "left").select("id", F.coalesce("c", "id").alias("class_id"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of its class; NULL for a
    NULL id) and ``kept`` (the id is its class's least, or NULL)."""
    classes = link_classes(docs, threshold, id_col, text).withColumn("kept", F.col("id") == F.col("class_id"))
    nulls = docs.select(F.col(id_col).cast("long").alias("id")).where("id is null") \
        .select("id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return classes.unionByName(nulls).withColumnRenamed("id", id_col)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
