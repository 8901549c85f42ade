"""Operator 4: approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid (k-means on a bounded sample).
A query is compared with the rows of its nearest lists. Rows are rotated by a random
orthogonal matrix and scanned in blocks of columns: after d of D columns the scaled
partial distance estimates the whole one, and a row is abandoned when the estimate
exceeds the current k-th distance by more than the test allows. Survivors get the
exact distance in double precision on the original vectors.

The number of lists probed is calibrated: for a bounded set of calibration queries
(some drawn from all rows, some spread over the lists, so that a hot cluster is not all
that is asked) the true neighbours are found by a scan of all rows. Enough lists are
probed to hold ``COVER`` of the neighbours of the former, and ``ENOUGH`` of those of each
query for ``COVER`` of the queries. A query whose lists hold fewer than k other rows goes
on to further lists until they do, or none are left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, prepare_python, table

K = 10
SAMPLE = 20_000        # vectors the index is fitted on
MAX_LISTS = 4096
CALIBRATE = 64         # calibration queries of either kind
COVER = 0.985          # share of true neighbours in the probed lists, and of queries with enough
ENOUGH = 0.9           # share of a query's true neighbours in its probed lists
GROUP_ROWS, GROUP_QUERIES = 20_000, 2_000  # of one task's group
BLOCK = 16             # columns per step
EPSILON = 2.1          # of the hypothesis test
SEED = 11


def usable(v: Column) -> Column:
    """Not NULL, no NULL or non-finite component, not zero."""
    return F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) &
        F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int):
    import numpy as np
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample, n_lists: int, rounds: int = 12):
    """Lloyd's iterations in numpy; an empty list takes the row farthest from its centroid."""
    import numpy as np
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        d = (c ** 2).sum(1) - 2 * sample @ c.T
        near = d.argmin(1)
        gap = d[np.arange(len(sample)), near] + (sample ** 2).sum(1)
        far = iter(np.argsort(-gap))
        for i in range(len(c)):
            own = sample[near == i]
            c[i] = own.mean(0) if len(own) else sample[next(far)]
    return c


def matrix(column):
    """float64 matrix of an Arrow list column of equal lengths."""
    import numpy as np
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _assign(vectors: DataFrame, centroids) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        c = centroids.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                near = ((c ** 2).sum(1) - 2 * x @ c.T).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32())],
                                                 names=["vec_id", "v", "list"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, list int")


def calibration_rows(sample, centroids):
    """Indices into the sample: the first ``CALIBRATE`` rows, and one row each of as many
    lists drawn from all."""
    import numpy as np
    near = ((centroids ** 2).sum(1) - 2 * sample @ centroids.T).argmin(1)
    _, first = np.unique(near, return_index=True)
    spread = np.random.default_rng(SEED).permutation(first)[:CALIBRATE]
    return np.concatenate([np.arange(min(CALIBRATE, len(sample))), spread])


def _probe_count(spark: SparkSession, index: DataFrame, centroids, queries, ids, k: int) -> int:
    """Lists to probe, from the true neighbours of the calibration queries (the first
    ``CALIBRATE`` drawn from all rows)."""
    import numpy as np
    held = spark.sparkContext.broadcast((queries, ids))

    def run(batches):
        import pyarrow as pa
        q, own = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            vid, lst = b.column(0).to_numpy(), b.column(2).to_numpy()
            out: list[list] = [[], [], [], []]
            for i in range(len(q)):
                d = ((x - q[i]) ** 2).sum(1)
                d[vid == own[i]] = np.inf
                for j in np.argpartition(d, min(k, len(d)) - 1)[:k]:
                    if d[j] < np.inf:
                        for c, val in zip(out, (i, int(vid[j]), float(d[j]), int(lst[j]))):
                            c.append(val)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())],
                                             names=["q", "vec_id", "d", "list"])

    near = index.select("vec_id", "v", "list").mapInArrow(run, "q int, vec_id long, d double, list int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    rows = near.withColumn("r", rank).where(F.col("r") <= k).select("q", "list").collect()
    order = np.argsort(((queries[:, None, :] - centroids[None]) ** 2).sum(2), 1, kind="stable")
    place = np.argsort(order, 1)
    depth: dict[int, list[int]] = {}
    for r in rows:
        depth.setdefault(r["q"], []).append(int(place[r["q"], r["list"]]) + 1)

    def reach(values, share):
        values = sorted(values)
        return values[math.ceil(share * len(values)) - 1] if values else 1
    pooled = reach([x for q, d in depth.items() if q < CALIBRATE for x in d], COVER)
    return max(pooled, reach([reach(d, ENOUGH) for d in depth.values()], COVER))


def scan(query, own_id: int, ids, original, rotated, rot_query, k: int):
    """(distances, ids) of the k nearest rows by the adaptive scan, nearest first."""
    import numpy as np
    dim = original.shape[1]
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    slack = 1e-9 * (1.0 + float((query ** 2).sum()))
    for at in range(0, len(ids), 2048):
        rows = np.arange(at, min(len(ids), at + 2048))
        limit = best_d[-1] ** 2 if len(best_d) == k else np.inf
        if limit < np.inf:
            part = np.zeros(len(rows))
            for lo in range(0, dim, BLOCK):
                hi = min(dim, lo + BLOCK)
                part += ((rotated[rows, lo:hi] - rot_query[lo:hi]) ** 2).sum(1)
                test = 1.0 if hi == dim else (1 + EPSILON / math.sqrt(hi)) ** 2 * hi / dim
                live = part <= limit * test + slack
                rows, part = rows[live], part[live]
                if not len(rows):
                    break
        rows = rows[ids[rows] != own_id]
        if not len(rows):
            continue
        d = np.sqrt(((original[rows] - query) ** 2).sum(1))
        best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[rows]])
        keep = np.lexsort((best_i, best_d))[:k]
        best_d, best_i = best_d[keep], best_i[keep]
    return best_d, best_i


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id",
                       vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for every query row.

    Rows take part if their id is not NULL, their vector is usable and as long as
    most vectors. Rows with a query's own id are not its candidates; an id that
    repeats is one query (its least vector). Ties go to the smaller id. Every query has
    ``k`` rows, or all candidates if there are fewer; an empty table gives an empty
    result.
    """
    import numpy as np
    spark = vectors.sparkSession
    prepare_python(spark)
    out_schema = "query_id long, rank int, vec_id long, score double"
    base = vectors.withColumn("_q", queries).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"),
        F.coalesce("_q", F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    shape = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], out_schema)
    dim, n = shape["dim"], shape["n"]
    base = base.where(F.size("v") == dim)
    picked = base.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "v").limit(SAMPLE).select("vec_id", "v").collect()
    sample = np.array([r["v"] for r in picked], np.float64)
    ids = np.array([r["vec_id"] for r in picked], np.int64)
    centroids = fit_centroids(sample, max(1, min(MAX_LISTS, round(math.sqrt(n)))))
    held = spark.sparkContext.broadcast(centroids)
    index = materialise(_assign(base, held), "ann-index")
    asking = calibration_rows(sample, centroids)
    probes = _probe_count(spark, index, centroids, sample[asking], ids[asking], k)
    # sizes per list: at most MAX_LISTS rows
    size = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    held_by = np.array([size.get(i, 0) for i in range(len(centroids))], np.int64)
    # with the rows that share the query's id, which are none of its candidates
    asked = base.groupBy("vec_id").agg(F.min(F.when(F.col("q"), F.col("v"))).alias("v"), F.count("*").alias("own")) \
        .where("v is not null")

    def probe(batches):
        import pyarrow as pa
        c = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            d = (c ** 2).sum(1) - 2 * x @ c.T
            near = np.argsort(d, 1, kind="stable").astype(np.int32)
            before = np.cumsum(held_by[near], 1) - held_by[near]  # rows in nearer lists
            probed = (np.arange(len(c)) < probes) | (before < k + b.column(2).to_numpy()[:, None])
            take = np.nonzero(probed)[0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(near[probed], pa.int32())],
                names=["vec_id", "v", "list"])

    probing = materialise(asked.mapInArrow(probe, "vec_id long, v array<double>, list int"), "ann-probes")
    load = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect()}
    # groups of one task: slices of a list's rows x blocks of the queries that probe it
    deal = spark.createDataFrame(
        [(lst, -(-size[lst] // GROUP_ROWS), -(-load[lst] // GROUP_QUERIES)) for lst in size if lst in load] or [(-1, 1, 1)],
        "list int, slices int, blocks int")
    rows = index.join(F.broadcast(deal), "list") \
        .withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), F.col("slices")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("list", "slice", "block", "vec_id", "v")
    asks = probing.join(F.broadcast(deal), "list") \
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")) \
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))) \
        .select("list", "slice", "block", "vec_id", "v")

    def search(left, right):
        import pandas as pd
        found: list[tuple] = []
        if len(left) and len(right):
            turn = rotation(dim)
            cid = left["vec_id"].to_numpy()
            original = np.stack(left["v"].to_numpy())
            rotated = original @ turn
            for qid, v in zip(right["vec_id"], right["v"]):
                v = np.asarray(v)
                d, i = scan(v, qid, cid, original, rotated, v @ turn, k)
                found += [(int(qid), int(x), float(y)) for x, y in zip(i, d)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["list", "slice", "block"]
    near = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)
