"""Data-parallel fitting in barrier stages (M7): many steps a Spark job.

:func:`epiframe.operators.scoring.fit_scorer` runs one job a step. Here the tasks of one
barrier stage hold the rows of the next ``steps_per_job`` batches, gather each other's
gradients after every step and make the same Adam update each, so no step waits for a
new job. A lost task fails the stage, which Spark runs again from the weights the job
started with; between jobs the state is saved, so a fit goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.operators.scoring import (AdamState, ScorerConfig, Weights, _arrow_vectors, adam_update, batch_gradient,
                                        load_state, random_weights, save_state)
from epiframe.session import scratch_path, ship_package

# Gradients gathered in one step pass through the stage's coordinator: tasks x model
# bytes, as text. Beyond this the step-by-step fit, whose sums are scattered, is the form.
MAX_GATHER_BYTES = 256 << 20

RESULT = "step int, loss double, rows long, state binary"


def _packed(w: Weights, state: AdamState) -> bytes:
    return np.concatenate([w.flat(), state.m, state.v, [float(state.t)]]).tobytes()


def _unpacked(raw: bytes, like: Weights) -> tuple[Weights, AdamState]:
    v = np.frombuffer(raw)
    n = like.flat().size
    return like.unflat(v[:n].copy()), AdamState(v[n:2 * n].copy(), v[2 * n:3 * n].copy(), int(v[3 * n]))


def fit_scorer_barrier(df: DataFrame, cfg: ScorerConfig, steps: int, steps_per_job: int, tasks: int,
                       batch_col: str, keys: Sequence[str] = (), lr: float = 1e-2, seed: int = 0,
                       vec: str = "vec", label: str = "label", dropout: bool = True,
                       init: Weights | None = None, save_path: str | None = None) -> tuple[Weights, list[tuple[int, float, int]]]:
    """Weights and (step, mean loss, rows) as :func:`fit_scorer` with ``batch_col`` gives
    them, with ``steps_per_job`` steps in each Spark job.

    ``tasks`` must not exceed the cluster's slots (a barrier stage starts all its tasks
    together). A task holds its share of the rows of ``steps_per_job`` batches. With
    ``save_path`` the state is saved after every job and a later call resumes there. A
    batch without rows ends the fit; sums are taken in task order, so every task and
    every run has the same weights.
    """
    spark = df.sparkSession
    ship_package(spark)
    w = init.copy() if init is not None else random_weights(cfg, seed)
    state = AdamState(np.zeros_like(w.flat()), np.zeros_like(w.flat()))
    if tasks * w.flat().nbytes * 4 // 3 > MAX_GATHER_BYTES:
        raise ValueError(f"{tasks} tasks would gather more than {MAX_GATHER_BYTES} bytes a step; use fit_scorer")
    first = 0
    if save_path is not None:
        saved = load_state(spark, save_path, w)
        if saved is not None:
            w, state, first = saved
    masked = bool(dropout and keys)
    if masked:
        from epiframe.operators.sampling import key_hash60

        df = df.withColumn("_kh", key_hash60(keys, seed))
    data = df.select(batch_col, vec, label, *(["_kh"] if masked else []))
    # written once by batch, so a job's range of batches is pushed to the scan
    path = scratch_path(spark, "fit-batches")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    data.repartitionByRange(parts, batch_col).sortWithinPartitions(batch_col).write.parquet(path)
    data = spark.read.parquet(path)
    n_batches = int(data.agg(F.max(batch_col)).first()[0] or 0) + 1
    names = sorted(w.arrays)
    history: list[tuple[int, float, int]] = []
    while first < steps:
        todo = list(range(first, min(first + steps_per_job, steps)))
        wanted = sorted({t % n_batches for t in todo})
        start = _packed(w, state)
        like = w

        def run(batches, todo=todo, start=start, like=like):
            import base64

            import pyarrow as pa
            from pyspark import BarrierTaskContext

            ctx = BarrierTaskContext.get()
            held: dict[int, list] = {}
            for rb in batches:
                if not rb.num_rows:
                    continue
                at = rb.column(batch_col).to_numpy(zero_copy_only=False)
                X, y = _arrow_vectors(rb, vec), rb.column(label).to_numpy(zero_copy_only=False).astype(np.float64)
                kh = rb.column("_kh").to_numpy(zero_copy_only=False) if masked else None
                for b in np.unique(at):
                    own = at == b
                    held.setdefault(int(b), []).append((X[own], y[own], kh[own] if masked else None))
            now, adam = _unpacked(start, like)
            out = []
            for t in todo:
                total, loss, rows = np.zeros(now.flat().size), 0.0, 0
                for X, y, kh in held.get(t % n_batches, ()):
                    v, part = batch_gradient(now, X, y, cfg, names, t if masked else None, kh)
                    total, loss, rows = total + v, loss + part, rows + len(y)
                told = base64.b64encode(np.concatenate([[rows, loss], total]).tobytes()).decode()
                every = [np.frombuffer(base64.b64decode(m)) for m in ctx.allGather(told)]
                rows, loss = int(sum(e[0] for e in every)), float(sum(e[1] for e in every))
                if rows == 0:
                    break
                total = every[0][2:].copy()
                for e in every[1:]:
                    total += e[2:]
                now = adam_update(now, now.unflat(total / rows), adam, lr)
                out.append((t, loss / rows, rows))
            if ctx.partitionId() == 0:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out] + [-1], pa.int32()), pa.array([o[1] for o in out] + [0.0]),
                     pa.array([o[2] for o in out] + [0], pa.int64()),
                     pa.array([None] * len(out) + [_packed(now, adam)], pa.binary())],
                    names=["step", "loss", "rows", "state"])

        dealt = data.where(F.col(batch_col).isin(wanted)).repartition(tasks)
        got = dealt.mapInArrow(run, RESULT, barrier=True).collect()  # a row a step and the state
        made = sorted((r["step"], r["loss"], r["rows"]) for r in got if r["step"] >= 0)
        history += made
        w, state = _unpacked(bytes(next(r["state"] for r in got if r["step"] < 0)), w)
        first = todo[-1] + 1
        if save_path is not None and made:
            save_state(spark, save_path, w, state, made[-1][0] + 1)
        if len(made) < len(todo):
            break
    return w, history
