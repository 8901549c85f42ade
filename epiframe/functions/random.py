"""Random numbers by arithmetic: the same bits in Spark columns, NumPy and any SQL engine.

* :func:`mix32` is a 32-bit integer hash (two xor-shift-multiply steps); both
  multipliers are below 2^31, so every product fits a signed 64-bit integer and no engine
  overflows. :func:`draw32` makes a counter-based generator of it: a number is a function
  of (row hash, step, unit), needs no state and is drawn again alike by a re-run task.
* :func:`permuted` is a keyed permutation of 0..n-1 (a Feistel network on a grid with
  cycle walking), so the place of a row in a shuffled order follows by arithmetic,
  without a sort or an exchange.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Shifts and multipliers of the mixing steps, as (shift, multiplier).
MIX_STEPS = ((16, 0x7FEB352D), (15, 0x31848BAB))
MIX_LAST_SHIFT = 16
MASK32 = 0xFFFFFFFF
# Offsets that tell the mixed fields apart.
FIELD_HIGH, FIELD_STEP, FIELD_UNIT = 1, 2, 3

# Fixed values of the permutation: a prime below 2^31 and the factor of each round's key.
PRIME = (1 << 31) - 1
ROUND_FACTORS = (48271, 69621, 742938285, 950706376, 1226874159, 62089911)
WALKS = 24


def mix32(x: Column) -> Column:
    """Hash of a BIGINT in 0..2^32-1 to the same range."""
    for shift, mult in MIX_STEPS:
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(mult).cast("bigint")).bitwiseAND(F.lit(MASK32))
    return x.bitwiseXOR(F.shiftright(x, MIX_LAST_SHIFT))


def row_state(row_hash: Column, step: Column) -> Column:
    """State of a row (non-negative hash below 2^63) in a step, from which its units draw."""
    low, high = row_hash.bitwiseAND(F.lit(MASK32)), F.shiftright(row_hash, 32)
    row = mix32(low.bitwiseXOR(mix32(high.bitwiseXOR(F.lit(FIELD_HIGH).cast("bigint")))))
    return row.bitwiseXOR(mix32((step.cast("bigint") * 8 + FIELD_STEP).bitwiseAND(F.lit(MASK32))))


def draw32(state: Column, unit: Column) -> Column:
    """The unit's number in 0..2^32-1."""
    return mix32(state.bitwiseXOR(mix32((unit.cast("bigint") * 8 + FIELD_UNIT).bitwiseAND(F.lit(MASK32)))))


def keep_threshold(keep_prob: float) -> int:
    return int(round(keep_prob * (1 << 32)))


def mix32_array(x):
    """:func:`mix32` of a NumPy uint64 array."""
    import numpy as np
    for shift, mult in MIX_STEPS:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(mult)) & np.uint64(MASK32)
    return x ^ (x >> np.uint64(MIX_LAST_SHIFT))


def draw32_array(row_hash, units: int, step: int):
    """Matrix (row, unit) of :func:`draw32`."""
    import numpy as np
    h = np.asarray(row_hash).astype(np.uint64)
    row = mix32_array((h & np.uint64(MASK32)) ^ mix32_array((h >> np.uint64(32)) ^ np.uint64(FIELD_HIGH)))
    state = row ^ mix32_array(np.uint64((step * 8 + FIELD_STEP) & MASK32))
    unit = mix32_array((np.arange(units, dtype=np.uint64) * np.uint64(8) + np.uint64(FIELD_UNIT)) & np.uint64(MASK32))
    return mix32_array(state[:, None] ^ unit[None, :])


def permutation_key(seed: int, *parts: Column) -> Column:
    """Key in 0..2^28-1 from a seed and columns (a NULL part is the text '~')."""
    text = F.concat_ws("|", F.lit(str(int(seed))), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def permuted_array(x, n, key):
    """Places of a NumPy int64 array: :func:`permuted` of many numbers at once."""
    import numpy as np
    a = np.floor(np.sqrt(n.astype(np.float64))).astype(np.int64) + 1
    b = n // a + 1
    out = np.empty_like(x)
    at, v = np.arange(len(x)), x
    for _ in range(WALKS + 1):
        left, right = v // b, v % b
        for i, f in enumerate(ROUND_FACTORS):
            y = ((left if i % 2 else right) + key * f % PRIME) % PRIME
            y = y * y % PRIME
            if i % 2:
                right = (right + y) % b
            else:
                left = (left + y) % a
        v = left * b + right
        out[at] = v
        beyond = np.flatnonzero(v >= n)
        if not len(beyond):
            return out
        at, v, n, key, a, b = (c[beyond] for c in (at, v, n, key, a, b))
    raise ValueError("permutation walk too long")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Place of ``x`` (0..n-1) in the order that ``key`` gives 0..n-1.

    0..n-1 lies in a grid of a x b > n cells, where every round adds a keyed square of
    one coordinate to the other; a place beyond n is sent through again. A chain longer
    than ``WALKS`` (its chance is about n^(-WALKS/2)) is an error, never a wrong row.

    Runs on Arrow batches: Spark interprets lambda functions of columns node by node. It
    is marked as not deterministic, though it is, so that a filter on the place does not
    compute it once more for each time it names it.
    """
    from epiframe.session import ship_package
    ship_package(SparkSession.active())

    @F.arrow_udf("bigint")
    def place(x: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
        if x.null_count or n.null_count or key.null_count:
            raise ValueError("permutation of NULL")
        return pa.array(permuted_array(*(c.to_numpy(zero_copy_only=False) for c in (x, n, key))))

    return place.asNondeterministic()(*[c.cast("bigint") for c in (x, n, key)])


def permute(x: int, n: int, key: int) -> int:
    """:func:`permuted` of one number, for checks."""
    import math
    a = math.floor(math.sqrt(n)) + 1
    b = n // a + 1
    while True:
        pair = [x // b, x % b]
        for i, f in enumerate(ROUND_FACTORS):
            y = (pair[1 - i % 2] + key * f % PRIME) % PRIME
            pair[i % 2] = (pair[i % 2] + y * y % PRIME) % (b if i % 2 else a)
        x = pair[0] * b + pair[1]
        if x < n:
            return x
