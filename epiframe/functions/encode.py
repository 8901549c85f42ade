"""Column expressions for sequence and category encoding.

All of these are built-in Spark expressions (higher-order array functions),
so they run inside the JVM next to the scan: no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiframe.functions.alphabet import PAD_CODE, PEPTIDE_WIDTH, alphabet_map


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _python_space_class() -> str:
    """Regex class of the characters Python's ``str.isspace`` accepts, written
    with ``\\x{...}`` escapes (understood by Java regex and RE2)."""
    cps = [cp for cp in range(0x110000) if chr(cp).isspace()]
    return "[" + "".join(f"\\x{{{cp:X}}}" for cp in cps) + "]"


PY_SPACE = _python_space_class()
STRIP_PATTERN = f"^{PY_SPACE}+|{PY_SPACE}+$"


def strip_blanks(c: Column | str) -> Column:
    """Python ``str.strip()``: removes whitespace at both ends, with Python's idea
    of whitespace (tabs, CR, LF, vertical tab, form feed, the Unicode spaces).

    Spark's ``trim`` removes spaces only and regex ``\\s`` is ASCII-only, so the
    class is built from Python's own rule.
    """
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def encode_letters(seq: Column | str, codes: dict[str, int] | None = None,
                   strict: bool = True) -> Column:
    """String -> ARRAY<INT> of residue codes, one per letter.

    An unknown letter has no code. ``strict`` fails the job on it, as the
    reference's dictionary look-up does; otherwise the element is NULL so that a
    caller can route the row to a reject output.
    """
    s = _col(seq)
    amap = alphabet_map(codes)
    if strict:
        # the check rides on the one transform: a letter without a code raises
        def code(ch):
            return F.coalesce(amap[ch], F.raise_error(
                F.concat(F.lit("unknown residue letter in: "), s)).cast("int"))
    else:
        def code(ch):
            return amap[ch]
    # split('', '') yields [''], so the empty string is handled on its own.
    out = F.when(s == "", F.array().cast("array<int>"))
    if strict:
        out = out.when(s.isNull(), F.raise_error(F.lit("sequence is NULL")).cast("array<int>"))
    return out.otherwise(F.transform(F.split(s, ""), code))


def pad_middle(codes: Column | str, maxlen: int = PEPTIDE_WIDTH) -> Column:
    """Left half + zeros + right half.

    The left part has ``k // 2`` elements, the right part the rest, and
    ``maxlen - k`` pad codes go between. A longer input is not cut: the pad run
    is empty and the array keeps its length (the width check happens in
    :func:`assemble`).
    """
    c = _col(codes)
    k = F.size(c)
    h = F.floor(k / 2).cast("int")
    pad = F.array_repeat(F.lit(PAD_CODE), F.lit(maxlen) - k)
    return F.concat(F.slice(c, F.lit(1), h), pad, F.slice(c, h + 1, k - h))


def peptide_vector(seq: Column | str, maxlen: int = PEPTIDE_WIDTH,
                   codes: dict[str, int] | None = None, strict: bool = True) -> Column:
    """E1 followed by E2."""
    return pad_middle(encode_letters(seq, codes, strict), maxlen)


def assemble(parts: Sequence[Column | str], width: int | None = None,
             as_double: bool = False, strict: bool = True) -> Column:
    """Concatenate code arrays (and scalar features) into one example vector.

    Scalars are wrapped into one-element arrays. ``as_double`` makes the whole
    vector DOUBLE, as mixing in a float feature does in the reference. With a
    ``width``, a vector of another size, a NULL part or a NULL element fails the job
    (``strict``) or makes the vector NULL.
    """
    elem = "double" if as_double else "int"
    arrays = []
    for p in parts:
        col = _col(p)
        arrays.append(col)
    vec = F.concat(*[a.cast(f"array<{elem}>") for a in arrays])
    if width is None:
        return vec
    bad = vec.isNull() | (F.size(vec) != F.lit(width)) | F.exists(vec, lambda x: x.isNull())
    if strict:
        return F.when(bad, F.raise_error(
            F.concat(F.lit(f"example vector has a NULL or its width is not {width}: "),
                     F.coalesce(F.size(vec).cast("string"), F.lit("NULL"))))).otherwise(vec)
    return F.when(bad, F.lit(None)).otherwise(vec)


def as_array(scalar: Column | str) -> Column:
    return F.array(_col(scalar))


def slice_features(vec: Column | str, widths: Sequence[int],
                   names: Sequence[str] | None = None) -> list[Column]:
    """Cut a vector into consecutive pieces of the given widths."""
    v = _col(vec)
    out, start = [], 1
    names = names or [f"part{i}" for i in range(len(widths))]
    for w, n in zip(widths, names):
        out.append(F.slice(v, start, w).alias(n))
        start += w
    return out


def one_hot(codes: Column | str, depth: int, flatten: bool = True,
            width: int | None = None) -> Column:
    """Rows of 0/1 of length ``depth``; a code outside [0, depth) gives a zero row.

    With ``width`` (the usual array length, e.g. 11 for peptide vectors) and
    ``flatten``, arrays of that length are built from per-position
    ``array_repeat``/``concat`` expressions, which whole-stage codegen compiles;
    arrays of any other length take the general higher-order-function form.
    """
    c = _col(codes).cast("array<int>")
    rows = F.transform(c, lambda x: F.transform(
        F.sequence(F.lit(0), F.lit(depth - 1)),
        lambda d: F.when(x == d, F.lit(1)).otherwise(F.lit(0))))
    if not flatten:
        return rows
    general = F.flatten(rows)
    if width is None:
        return general
    blocks = []
    for p in range(width):
        x = F.get(c, p)
        hit = F.concat(F.array_repeat(F.lit(0), x), F.array(F.lit(1)),
                       F.array_repeat(F.lit(0), F.lit(depth - 1) - x))
        blocks.append(F.when((x >= 0) & (x < depth), hit)
                      .otherwise(F.array_repeat(F.lit(0), depth)))
    return F.when(F.size(c) == width, F.concat(*blocks)).otherwise(general)


def multi_hot(codes: Column | str, n: int = 100) -> Column:
    """Count of each category code 1..n; code 0 (and codes above n) count nowhere.

    Duplicates count twice, so a homozygous sample weighs its allele double.
    """
    c = _col(codes).cast("array<int>")
    return F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda i: F.size(F.filter(c, lambda x: x == i)))
