"""Operator 12: product codes of vectors, learned by exact whole-number k-means.

Vectors become whole numbers, are cut into parts, and each part position has its own
codebook. The rows of a part are laid out once along a Hilbert curve and cut into flat
blocks, which store the box (least and greatest component), the sum and the number of
their rows. In a round a block first bounds its distances by its box: an entry whose
least distance to the box exceeds the greatest distance of another one cannot be nearest
to any row and leaves the block's shortlist. A block with one entry left adds its stored
sum and looks at no row; the others evaluate their shortlist exactly.

Blocks are written once as Parquet; each round is one job over them that returns counts
and sums per entry, whose size depends on the codebooks alone. Equal subvectors are
dealt over tasks by row number, so a hot vector is no hot task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, prepare_python, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 512
KEY_BITS = 62           # of the Hilbert key

_BLOCK = ("part int, n int, rids binary, lo array<long>, hi array<long>, total array<long>, "
          "width int, rows binary")


def finite(v: Column) -> Column:
    """Not NULL and without a NULL or non-finite component."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
                      F.lit(False))


def largest_component(dim: int) -> int:
    """Whole-number components up to this keep every sum of squares of a vector below
    2^63, the range of the error column."""
    return min((1 << 31) - 1, int((2 ** 61 / max(dim, 1)) ** 0.5))


def hilbert_keys(x, bits: int):
    """Position along a Hilbert curve of each row of ``x`` (rows x axes, 0 <= x < 2^bits).

    The transposed form of J. Skilling's "Programming the Hilbert curve" (2004), on all
    rows at once.
    """
    import numpy as np
    x = x.astype(np.int64).T.copy()
    axes = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(axes):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[axes - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[i] >> b & 1
    return key


def part_slices(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of equal width; the last ones are shorter (or empty) when the
    width is no divisor."""
    w = -(-dim // parts)
    return [slice(min(i * w, dim), min((i + 1) * w, dim)) for i in range(parts)]


def shortlist(lo, hi, codebook):
    """Entries that may be nearest to a point of the box, ascending."""
    import numpy as np
    below, above = lo - codebook, codebook - hi
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(codebook - hi))
    far = np.maximum(far, np.abs(codebook - lo))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(rows, codebook, among):
    """(index, squared distance) of the nearest entry among the ascending ``among``;
    ties go to the lower index."""
    import numpy as np
    best = np.full(len(rows), among[0])
    gap = rows - codebook[among[0]]
    least = (gap * gap).sum(1)
    for e in among[1:]:
        gap = rows - codebook[e]
        d = (gap * gap).sum(1)
        closer = d < least
        best[closer] = e
        least = np.where(closer, d, least)
    return best, least


def read_block(n: int, width: int, raw: bytes):
    import numpy as np
    kind = np.int16 if len(raw) == 2 * n * width else np.int32
    return np.frombuffer(raw, dtype=kind).reshape(n, width).astype(np.int64)


def flat_blocks(vectors: DataFrame, dim: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of ``vectors`` (rid long, q array<int>), by part and Hilbert order."""
    spark = vectors.sparkSession
    prepare_python(spark)
    slices = part_slices(dim, parts)
    span = vectors.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bounds = {r["i"]: (r["lo"], r["hi"]) for r in span.collect()}  # one row a component

    def keyed(batches):
        import numpy as np
        import pyarrow as pa
        lo = np.array([bounds[i][0] for i in range(dim)], np.float64)
        wide = np.array([bounds[i][1] for i in range(dim)], np.float64) - lo + 1
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(1).flatten().to_numpy().reshape(b.num_rows, dim)
            rid = b.column(0)
            for p, s in enumerate(slices):
                x = q[:, s]
                axes = x.shape[1]
                small = np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int32
                if axes:
                    used = min(axes, KEY_BITS)
                    bits = max(1, min(16, KEY_BITS // used))
                    cell = ((x[:, :used] - lo[s][:used]) / wide[s][:used] * (1 << bits)).astype(np.int64)
                    key = hilbert_keys(np.minimum(cell, (1 << bits) - 1), bits)
                else:
                    key = np.zeros(len(x), np.int64)
                body = np.ascontiguousarray(x.astype(small))
                raw, each = body.tobytes(), body.itemsize * axes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array(key), rid,
                     pa.array([raw[i * each:(i + 1) * each] for i in range(len(x))], pa.binary())],
                    names=["part", "h", "rid", "x"])

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        part, rids, rows = None, [], []

        def block():
            axes = slices[part].stop - slices[part].start
            xs = [np.frombuffer(r, np.int16 if len(r) == 2 * axes else np.int32) for r in rows]
            x = np.stack(xs).astype(np.int64) if axes else np.zeros((len(rows), 0), np.int64)
            small = np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int32
            return pa.RecordBatch.from_pylist([{
                "part": part, "n": len(rows), "rids": np.array(rids, np.int64).tobytes(),
                "lo": x.min(0).tolist(), "hi": x.max(0).tolist(), "total": x.sum(0).tolist(),
                "width": axes, "rows": x.astype(small).tobytes()}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("rids", pa.binary()),
                            ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())),
                            ("total", pa.list_(pa.int64())), ("width", pa.int32()), ("rows", pa.binary())])
        for b in batches:
            for p, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if rows and (p != part or len(rows) == block_rows):
                    yield block()
                    rids, rows = [], []
                part = p
                rids.append(r)
                rows.append(x)
        if rows:
            yield block()

    moved = vectors.select("rid", "q").mapInArrow(keyed, "part int, h long, rid long, x binary")
    laid = moved.repartitionByRange("part", "h", "rid").sortWithinPartitions("part", "h", "rid")
    return materialise(laid.select("part", "rid", "x").mapInArrow(cut, _BLOCK), "vector-blocks")


def _sums(blocks: DataFrame, books: list) -> list:
    """One round: (part, entry, rows, component sums) of every entry in use."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        count = [np.zeros(len(c), np.int64) for c in books]
        total = [np.zeros(c.shape, np.int64) for c in books]
        for b in batches:
            for r in range(b.num_rows):
                p, n = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                lo, hi = (np.array(b.column(i)[r].as_py(), np.int64) for i in (2, 3))
                among = shortlist(lo, hi, books[p])
                if len(among) == 1:
                    count[p][among[0]] += n
                    total[p][among[0]] += np.array(b.column(4)[r].as_py(), np.int64)
                    continue
                x = read_block(n, b.column(5)[r].as_py(), b.column(6)[r].as_py())
                best, _ = nearest(x, books[p], among)
                for e in among:
                    own = best == e
                    count[p][e] += own.sum()
                    total[p][e] += x[own].sum(0)
        out = [(p, int(e), -1, int(count[p][e])) for p in range(len(books)) for e in np.flatnonzero(count[p])]
        out += [(p, int(e), i, int(x)) for p in range(len(books)) for e in np.flatnonzero(count[p])
                for i, x in enumerate(total[p][e])]
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
             pa.array(cols[3], pa.int64())], names=["part", "entry", "i", "s"])

    heads = blocks.select("part", "n", "lo", "hi", "total", "width", "rows")
    return heads.mapInArrow(run, "part int, entry int, i int, s long") \
        .groupBy("part", "entry", "i").agg(F.sum("s").alias("s")).collect()  # entries x (width + 1)


def learn_codebooks(blocks: DataFrame, start, parts: int = PARTS, rounds: int = ROUNDS) -> list:
    """Codebooks (entries x width, one a part) after ``rounds`` rounds from the rows of
    ``start``. A round that changes nothing ends them: the rest would change nothing."""
    import numpy as np
    books = [start[:, s].copy() for s in part_slices(start.shape[1], parts)]
    for _ in range(rounds):
        found = {(r["part"], r["entry"], r["i"]): r["s"] for r in _sums(blocks, books)}
        after = [c.copy() for c in books]
        for p, c in enumerate(after):
            for e in range(len(c)):
                n = found.get((p, e, -1), 0)
                if n:
                    c[e] = [found[p, e, i] // n for i in range(c.shape[1])]  # // goes down
        if all((a == b).all() for a, b in zip(after, books)):
            break
        books = after
    return [np.asarray(c) for c in books]


def assign_codes(blocks: DataFrame, books: list) -> DataFrame:
    """(rid, part, entry, error) of every part."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for r in range(b.num_rows):
                p, n = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                lo, hi = (np.array(b.column(i)[r].as_py(), np.int64) for i in (3, 4))
                x = read_block(n, b.column(5)[r].as_py(), b.column(6)[r].as_py())
                best, d = nearest(x, books[p], shortlist(lo, hi, books[p]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b.column(2)[r].as_py(), np.int64)), pa.array(np.full(n, p, np.int32)),
                     pa.array(best.astype(np.int32)), pa.array(d)], names=["rid", "part", "entry", "error"])

    return blocks.select("part", "n", "rids", "lo", "hi", "width", "rows") \
        .mapInArrow(run, "rid long, part int, entry int, error long")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """(vec_id, code, error, label_error) of every kept vector, and the codebooks.

    Rows whose vector is NULL or holds NULL or non-finite components are dropped. The
    width is that of most kept rows (ties: the greater); a row of another width, or with
    a component beyond :func:`largest_component` (its error would not fit a long), has
    no place in the codebooks and comes back with NULL code and error. A width that
    ``parts`` does not divide leaves the last parts shorter. Fewer rows than ``entries``
    make smaller codebooks. Starting rows with equal ids are taken in order of their
    components; a NULL id comes last. Equal rows count as often as they occur. Labels
    are compared with NULLs equal. An empty table gives no rows. Further columns are not
    looked at, so their names cannot clash.
    """
    import numpy as np
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")) \
        .where(finite(F.col("v")))
    widths = base.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    dim = widths["w"] if widths else 0
    most = largest_component(dim)
    fits = (F.size("v") == dim) & F.forall("v", lambda x: F.abs(x.cast("double") * SCALE) < float(most))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("int"))
    kept = materialise(base.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label",
                                   F.when(fits, whole).alias("q")), "vector-rows")
    usable = kept.where("q is not null").select("rid", "vec_id", "q")
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    if first:
        start = np.array([r["q"] for r in first], np.int64).reshape(len(first), dim)
        blocks = flat_blocks(usable, dim, parts)
        books = learn_codebooks(blocks, start, parts, rounds)
        two = F.lpad(F.lower(F.hex("entry")), 2, "0")
        codes = assign_codes(blocks, books).groupBy("rid").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", two.alias("c")))),
                                     lambda s: s["c"]), "").alias("code"),   # one row a part
            F.sum("error").alias("error"))
    else:
        books = [np.zeros((0, 0), np.int64)] * parts
        codes = spark.createDataFrame([], "rid long, code string, error long")
    coded = materialise(kept.select("rid", "vec_id", "label").join(codes, "rid", "left"), "vector-codes")
    per_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("l")), "left") \
        .select("vec_id", "code", "error", "label_error")
    return out, books


def codebooks_digest(books: list) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for c in books for x in c.ravel()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def _oracle() -> str:
    floor_mean = "(sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*)"
    sql = [f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (
  select vec_id, p::integer p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] v
  from kept, range({PARTS}) r(p)),
b0 as materialized (
  select p, (dense_rank() over (order by vec_id) - 1)::integer e, v c from part
  where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES})),"""]
    for r in range(ROUNDS + 1):
        sql.append(f"""
a{r} as materialized (
  select vec_id, p, v, min(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint * {ENTRIES} + e) m
  from part join b{r} using (p) group by all),""")
        if r < ROUNDS:
            sql.append(f"""
u{r} as (select p, (m % {ENTRIES})::integer e, i, {floor_mean} x
        from a{r}, lateral (select unnest(range(1, len(v) + 1)) i) group by all),
n{r} as (select p, e, list(x::bigint order by i) c from u{r} group by all),
b{r + 1} as materialized (select p, e, coalesce(n{r}.c, b{r}.c) c from b{r} left join n{r} using (p, e)),""")
    sql.append(f"""
coded as (select vec_id, string_agg(printf('%02x', (m % {ENTRIES})::integer), '' order by p) code,
                 sum(m // {ENTRIES})::bigint error from a{ROUNDS} group by vec_id),
flat as (select p, e, unnest(c) x, generate_subscripts(c, 1) i from b{ROUNDS}),
digest as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) codebooks_sha256 from flat)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256
from coded join kept using (vec_id), digest""")
    return "".join(sql)


OP12_ORACLE = _oracle()
