"""Row sampling.

``sample_rows`` is Spark's Bernoulli sampler: seeded, but its rows change when
the input's partitioning changes. ``sample_by_key`` decides per row from a hash
of the row key, so the same rows are kept under any layout, on a retried task,
and in another engine computing the same md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPACE = 1_000_000


def key_text(keys: Sequence[str | Column], seed: int | None = None) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = [c.cast("string") for c in cols]
    if seed is not None:
        parts.append(F.lit(str(int(seed))))
    return F.concat_ws("|", *parts)


def key_hash32(keys: Sequence[str | Column], seed: int | None = None) -> Column:
    """First 32 bits of md5(key text) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(key_text(keys, seed)), 1, 8), 16, 10).cast("bigint")


def key_hash60(keys: Sequence[str | Column], seed: int | None = None) -> Column:
    """First 60 bits of md5(key text) as a non-negative BIGINT (sort key)."""
    return F.conv(F.substring(F.md5(key_text(keys, seed)), 1, 15), 16, 10).cast("bigint")


def keep_by_key(keys: Sequence[str | Column], fraction: float, seed: int | None = None) -> Column:
    threshold = int(round(fraction * HASH_SPACE))
    return (key_hash32(keys, seed) % HASH_SPACE) < F.lit(threshold)


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample without replacement (the reference's form, now seeded)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_by_key(df: DataFrame, keys: Sequence[str], fraction: float,
                  seed: int | None = None) -> DataFrame:
    """Keep a row when hash(key) falls in the first ``fraction`` of the hash space."""
    return df.filter(keep_by_key(keys, fraction, seed))


def downsample_class(df: DataFrame, label: str, keys: Sequence[str], fraction: float,
                     sampled_value=0, seed: int | None = None) -> DataFrame:
    """Sample only the rows of one class; all other rows are kept whole.

    A NULL label is another class and is kept. One filter, so positives and sampled negatives come out of a single scan.
    """
    return df.filter(~F.col(label).eqNullSafe(F.lit(sampled_value)) | keep_by_key(keys, fraction, seed))


def downsample_class_bernoulli(df: DataFrame, label: str, fraction: float,
                               sampled_value=0, seed: int = 0) -> DataFrame:
    """Seeded Bernoulli form: ``rand(seed)`` decides for the sampled class only.

    Like ``sample_rows`` its rows depend on the partitioning of the input.
    """
    return df.filter(~F.col(label).eqNullSafe(F.lit(sampled_value)) | (F.rand(seed) < F.lit(fraction)))
