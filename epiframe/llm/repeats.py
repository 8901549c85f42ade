"""Operator 10: remove repeated byte strings with a distributed, sampled suffix array.

A byte is removed when a string of ``WINDOW`` bytes covers it that also starts
somewhere else in the corpus. Every window is served by one sampled suffix: the
position among its first ``STARTS`` ones with the least hash of the next 8 bytes
(leftmost on ties). Equal windows choose the same relative position, so windows are
equal only if their suffixes share the first ``CORE`` bytes.

1. Suffixes are sampled, each with the range of window starts it serves. A suffix
   whose first ``CORE`` bytes are unique serves no repeated window and is dropped.
2. Suffixes with equal whole extents (all bytes of all windows they serve) are
   repeated as a whole; one of each goes on.
3. The rest are range-partitioned by their leading bytes with splitters that Spark
   samples; equal ``CORE`` bytes never straddle a boundary, so no match does. Each
   bucket is sorted by multikey quicksort and gets its LCP array. A window that
   starts j bytes before a suffix is repeated if another suffix has an LCP of at
   least ``WINDOW`` - j with it and the same j bytes before.
4. A class too large for a bucket is cut by longer leading strings: windows that
   start up to the middle offset share more bytes after the suffix, the others more
   bytes before it. Each half is keyed by the bytes that all its windows contain and
   goes through 2 and 3 again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, prepare_python, table

WINDOW = 400
CORE = WINDOW // 2
STARTS = WINDOW - CORE + 1
CHUNK = 8 << 20               # bytes of a long text worked on at a time
BUCKET = 20_000               # suffixes of one sort bucket
SALTS = 8                     # shares a class of suffixes is dealt into where its extents are joined

SUFFIX = "d long, t long, x long, lo long, hi long, g long, u long"
RECORD = "d long, t long, x long, off int, j0 int, j1 int, a int, b int, res boolean, node long, uk long, ctx binary"
SPAN = "d long, t long, s long, e long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sample_suffixes(data: bytes):
    """(x, lo, hi) arrays: sampled positions and the window starts each serves."""
    import numpy as np
    n = len(data)
    xs, los, his = [], [], []
    for at in range(0, max(n - WINDOW + 1, 0), CHUNK):
        part = data[at:at + CHUNK + WINDOW - 1]
        m = len(part) - WINDOW + 1  # window starts in this chunk
        grams = np.ndarray((m + STARTS - 1,), "<u8", buffer=part, strides=(1,)) if WINDOW - STARTS >= 7 else None
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h &= np.uint64(0xFFFFFFFFFF000000)
        h |= np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= STARTS:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        if size < STARTS:
            h = np.minimum(h[:m], h[STARTS - size:STARTS - size + m])
        pos = (h & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(pos)) + 1
        lo = np.concatenate([[0], cut])
        hi = np.concatenate([cut - 1, [m - 1]])
        xs.append(pos[lo] + at)
        los.append(lo + at)
        his.append(hi + at)
    if not xs:
        return [np.zeros(0, np.int64)] * 3
    return [np.concatenate(v) for v in (xs, los, his)]


def _suffixes(docs: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as h64
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = text.as_py()
                if data is None or len(data) < WINDOW:
                    continue
                x, lo, hi = sample_suffixes(data)
                view = memoryview(data)
                xl, ll, hl = x.tolist(), lo.tolist(), hi.tolist()
                cols[0].append(np.full(len(x), d, np.int64))
                cols[1].append(np.full(len(x), t, np.int64))
                for i, v in ((2, x), (3, lo), (4, hi)):
                    cols[i].append(v)
                cols[5].append(np.array([h64(view[p:p + CORE]) for p in xl], np.uint64).view(np.int64))
                cols[6].append(np.array([h64(view[i:j + WINDOW], p - i) for p, i, j in zip(xl, ll, hl)],
                                        np.uint64).view(np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["d", "t", "x", "lo", "hi", "g", "u"])

    return docs.mapInArrow(run, SUFFIX)


def _contexts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Records of representative suffixes with the bytes of their extents."""
    wanted = materialise(reps.groupBy("d", "t").agg(
        F.collect_list(F.struct("x", "lo", "hi", "g", "u", "res")).alias("w")), "repeats-wanted")

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as h64
        names = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            rows: list[dict] = []
            for d, t, text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                data = memoryview(text.as_py() or b"")
                for w in want.as_py():
                    x, lo, hi = w["x"], w["lo"], w["hi"]
                    ctx = bytes(data[lo:hi + WINDOW])
                    rows.append({"d": d, "t": t, "x": x, "off": x - lo, "j0": 0, "j1": WINDOW - CORE, "a": x - hi,
                                 "b": x - lo, "res": w["res"], "node": _signed(h64(data[x:x + CORE])),
                                 "uk": w["u"], "ctx": ctx})
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in part], ty) for n, ty in zip(names, _arrow_types())], names=names)

    both = docs.join(wanted, ["d", "t"])
    return both.select("d", "t", "text", "w").mapInArrow(run, RECORD)


def _arrow_types():
    import pyarrow as pa
    return [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(),
            pa.bool_(), pa.int64(), pa.int64(), pa.binary()]


def _halves(records: DataFrame) -> DataFrame:
    """Records of oversize classes, once per half of the offsets they still serve."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as h64
        names = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                mid = (r["j0"] + r["j1"]) // 2
                for j0, j1 in ((r["j0"], mid), (mid + 1, r["j1"])):
                    lo, hi = max(r["a"], j0), min(r["b"], j1)
                    if j0 > j1 or lo > hi:
                        continue
                    off, ctx = r["off"], r["ctx"]
                    core = ctx[off - j0:off + WINDOW - j1]
                    extent = ctx[off - hi:off + WINDOW - lo]
                    rows.append(r | {"j0": j0, "j1": j1, "a": lo, "b": hi, "node": _signed(h64(core, j0 * 1024 + j1)),
                                     "uk": _signed(h64(extent, lo * 1024 + hi))})
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], ty) for n, ty in zip(names, _arrow_types())], names=names)

    return records.select(*[c.split()[0] for c in RECORD.split(", ")]).mapInArrow(run, RECORD)


def multikey_quicksort(words, lengths, raw):
    """Order of byte strings given as rows of big-endian 64-bit words (zero padded),
    shorter first on ties: three-way partitions on one word at a time."""
    import numpy as np
    out = []
    stack = [(np.arange(len(words)), 0)]
    while stack:
        idx, depth = stack.pop()
        if len(idx) <= 1:
            out.append(idx)
        elif depth == words.shape[1]:
            out.append(idx[np.argsort(lengths[idx], kind="stable")])
        elif len(idx) <= 24:
            out.append(np.array(sorted(idx.tolist(), key=lambda i: (raw[i].tobytes(), lengths[i])), idx.dtype))
        else:
            w = words[idx, depth]
            pivot = np.partition(w, len(w) // 2)[len(w) // 2]
            stack.append((idx[w > pivot], depth))
            stack.append((idx[w == pivot], depth + 1))
            stack.append((idx[w < pivot], depth))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_windows(ctx: list[bytes], off, a, b, group):
    """Boolean matrix (suffix, offset j): the window starting j bytes before the suffix
    is also served by another suffix of the same ``group``."""
    import numpy as np

    from epiframe.llm.neardup import mix64
    n, reach = len(ctx), WINDOW - CORE
    right = np.zeros((n, WINDOW), np.uint8)
    left = np.zeros((n, reach), np.uint8)
    rlen = np.zeros(n, np.int64)
    for i, c in enumerate(ctx):
        o = int(off[i])
        r = np.frombuffer(c, np.uint8)
        tail = r[o:o + WINDOW]
        right[i, :len(tail)] = tail
        rlen[i] = len(tail)
        left[i, :o] = r[:o][::-1][:reach]
    order = multikey_quicksort(right.view(">u8").astype(np.uint64), rlen, right)
    right, left, rlen = right[order], left[order], rlen[order]
    lo, hi, grp = a[order], b[order], group[order]
    # LCP with the suffix before in the sorted order
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 8192):
        end = min(n, at + 8192)
        diff = right[at:end] != right[at - 1:end - 1]
        first = np.where(diff.any(1), diff.argmax(1), WINDOW)
        lcp[at:end] = np.minimum(first, np.minimum(rlen[at:end], rlen[at - 1:end - 1]))
    found = np.zeros((n, reach + 1), bool)
    before = grp.astype(np.int64).view(np.uint64).copy()
    for j in range(reach + 1):
        if j:
            before = mix64(before * np.uint64(257) + left[:, j - 1] + np.uint64(1))
        on = np.flatnonzero((lo <= j) & (j <= hi))
        if len(on) < 2:
            continue
        run = np.cumsum(lcp < WINDOW - j)[on].astype(np.uint64)
        key = mix64(before[on] ^ mix64(run + np.uint64(j << 40)))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        found[order[on[count[back] > 1]], j] = True
    return found


def _sorted_buckets(records: DataFrame) -> DataFrame:
    n = records.count()
    buckets = max(1, -(-n // BUCKET))
    lead = F.substring(F.col("ctx"), F.col("off") + 1, F.lit(CORE))
    # "node" tells the offset ranges of cut classes apart; whole classes have one node
    dealt = records.repartitionByRange(buckets, lead, F.col("node"))

    def run(batches):
        # the suffixes of one bucket: about BUCKET rows by the sampled splitters
        import numpy as np
        import pyarrow as pa
        batches = list(batches)
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        col = {k: whole.column(k).to_numpy() for k in ("d", "t", "x", "off", "a", "b", "res", "node")}
        ctx = whole.column("ctx").to_pylist()
        found = repeated_windows(ctx, col["off"], col["a"], col["b"], col["node"])
        out: list[list] = [[], [], [], []]
        for i in np.flatnonzero(found.any(1) & ~col["res"]):
            js = np.flatnonzero(found[i])
            for run_ in np.split(js, np.flatnonzero(np.diff(js) > 1) + 1):
                for c, v in zip(out, (col["d"][i], col["t"][i], col["x"][i] - run_[-1], col["x"][i] - run_[0] + WINDOW)):
                    c.append(int(v))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["d", "t", "s", "e"])

    return dealt.select("d", "t", "x", "off", "a", "b", "res", "node", "ctx").mapInArrow(run, SPAN)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, t, s, e): byte ranges covered by repeated windows; ``docs`` has d, t, text
    (bytes). Ranges of one text may overlap."""
    prepare_python(docs.sparkSession)
    suffixes = materialise(_suffixes(docs.select("d", "t", "text")), "repeats-suffixes")
    keys = suffixes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    # the key table is written, so both sides of the join are plain exchanges, which
    # adaptive execution splits at a hot core
    alive = materialise(suffixes.join(materialise(keys, "repeats-keys"), "g", "left_semi"), "repeats-alive")
    extents = materialise(alive.groupBy("g", "u").agg(
        F.count("*").alias("n"), F.min(F.struct("d", "t", "x", "lo", "hi")).alias("r")), "repeats-extents")
    spans = [alive.join(extents.where("n > 1").select("g", "u"), ["g", "u"])
             .select("d", "t", F.col("lo").alias("s"), (F.col("hi") + WINDOW).alias("e"))]
    mixed = extents.groupBy("g").agg(F.count("*").alias("nu")).where("nu > 1").select("g")
    # extents of a hot core are dealt by (g, salt): SALTS rows of two numbers a core
    salted = mixed.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    reps = extents.withColumn("salt", F.pmod("u", F.lit(SALTS).cast("long"))).join(salted, ["g", "salt"]) \
        .select("g", "u", "r.*", (F.col("n") > 1).alias("res"))
    records = materialise(_contexts(docs, reps), "repeats-records")
    while True:
        sizes = records.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("node")
        sizes = materialise(sizes, "repeats-oversize")
        big = sizes.count()
        fits = records.join(sizes, "node", "left_anti") if big else records
        spans.append(materialise(_sorted_buckets(fits), "repeats-spans"))
        if not big:
            break
        cut = materialise(_halves(records.join(sizes, "node", "left_semi")), "repeats-halves")
        extent = cut.groupBy("node", "uk").agg(
            F.count("*").alias("n"), F.max("res").alias("any"), F.min(F.struct("d", "t", "x")).alias("r"))
        extent = materialise(extent, "repeats-half-extents")
        whole = cut.where("not res").join(extent.where("n > 1 or any").select("node", "uk"), ["node", "uk"])
        spans.append(whole.select("d", "t", (F.col("x") - F.col("b")).alias("s"),
                                  (F.col("x") - F.col("a") + WINDOW).alias("e")))
        several = extent.groupBy("node").agg(F.count("*").alias("nu")).where("nu > 1").select("node")
        keep = extent.join(several, "node").select("node", "uk", "r", (F.col("any") | (F.col("n") > 1)).alias("now"))
        records = cut.join(keep, ["node", "uk"]).where(F.struct("d", "t", "x") == F.col("r")) \
            .withColumn("res", F.col("now")).dropDuplicates(["node", "uk"]) \
            .select(*[c.split()[0] for c in RECORD.split(", ")])
        records = materialise(records, "repeats-records")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of byte ranges."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed byte runs) and
    ``kept`` (the remaining bytes).

    NULL texts count as empty. Rows that share an id stay separate unless their texts
    are equal too (then both are copies of each other, and treated alike). Texts
    shorter than the window lose nothing. Bytes are judged on the input only.
    """
    prepare_python(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_s")) \
        .select("_id", F.coalesce("_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("_s").alias("t"),
                F.encode("_s", "UTF-8").alias("text"))
    spans = repeated_spans(src).groupBy("d", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def run(batches):
        import pyarrow as pa
        names = ["_id", "n_bytes", "n_removed", "spans", "kept"]
        span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, sp in zip(b.column(1), b.column(2)):
                data = t.as_py() or b""
                runs = merge_spans((x["s"], x["e"]) for x in (sp.as_py() or ()))
                at, parts = 0, []
                for s, e in runs:
                    parts.append(data[at:s])
                    at = e
                parts.append(data[at:])
                out[0].append(len(data))
                out[1].append(sum(e - s for s, e in runs))
                out[2].append([{"s": s, "e": e} for s, e in runs])
                out[3].append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span_type),
                 pa.array(out[3], pa.binary())], names=names)

    return src.join(spans, ["d", "t"], "left").select("_id", "text", "spans") \
        .mapInArrow(run, "_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary") \
        .withColumnRenamed("_id", id_col)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and what is kept as a string (a character that lost some of
    its bytes shows as U+FFFD; the digest is of the bytes)."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def repeated_spans_by_force(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Reference for tests: every window of every text."""
    from collections import Counter
    seen = Counter(hashlib.blake2b(t[i:i + WINDOW]).digest() for t in texts for i in range(len(t) - WINDOW + 1))
    return [merge_spans((i, i + WINDOW) for i in range(len(t) - WINDOW + 1)
                        if seen[hashlib.blake2b(t[i:i + WINDOW]).digest()] > 1) for t in texts]
