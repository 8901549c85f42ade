"""Example assembly: peptide codes + sample codes [+ abundance] [+ flank]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.functions.alphabet import PEPTIDE_WIDTH
from epiframe.functions.encode import assemble, encode_letters, pad_middle, peptide_vector
from epiframe.operators.lookup import attach_sample_codes

# Fixed layout widths: peptide, sample codes, abundance, flank.
LAYOUT_WIDTHS = {"peptide": PEPTIDE_WIDTH, "alleles": 6, "abundance": 1, "flank": 10}
VARIANT_WIDTH = {"base": 17, "abundance": 18, "flank": 28}


def encode_flank(flank, width: int = LAYOUT_WIDTHS["flank"], strict: bool = True,
                 codes=None):
    """Flanking residues -> exactly ``width`` codes (no padding). ``codes`` may
    pass the already encoded letters (a column), so they are not encoded twice."""
    codes = encode_letters(flank, strict=strict) if codes is None else codes
    bad = ~F.size(codes).eqNullSafe(F.lit(width))
    if strict:
        return F.when(bad, F.raise_error(F.concat(
            F.lit(f"flank is not {width} residues: "), F.coalesce(flank, F.lit("NULL"))))
        ).otherwise(codes)
    return F.when(bad, F.lit(None)).otherwise(codes)


def encode_examples(seqs: DataFrame, sample_codes: DataFrame, variant: str = "base",
                    seq_col: str = "seq", key: str = "sample_id",
                    abundance_col: str = "abundance", flank_col: str = "flank",
                    strict: bool = True) -> DataFrame:
    """Add ``vec``: the fixed-width example vector of each labelled sequence.

    ``base`` = 11 peptide + 6 allele codes (INT); ``abundance`` appends the
    abundance and turns the vector DOUBLE (width 18); ``flank`` also appends 10
    flank codes (width 28). Unknown letters, unknown samples and wrong widths
    fail the job in ``strict`` mode. Otherwise rows of unknown samples are
    dropped and rows with an unknown letter or a wrong width get a NULL vector
    (:func:`encode_examples_checked` says why).
    """
    width = VARIANT_WIDTH[variant]
    df = attach_sample_codes(seqs, sample_codes, key=key, strict=strict)
    # the peptide vector is a column of its own: the width check below reads the
    # assembled vector twice, and must not encode the letters twice
    df = df.withColumn("_pep", peptide_vector(F.col(seq_col), PEPTIDE_WIDTH, strict=strict))
    parts = [F.col("_pep"), F.col("codes")]
    as_double = variant != "base"
    if variant in ("abundance", "flank"):
        parts.append(F.array(F.col(abundance_col).cast("double")))
    if variant == "flank":
        df = df.withColumn("_fl", encode_letters(F.col(flank_col), strict=strict))
        parts.append(encode_flank(F.col(flank_col), strict=strict, codes=F.col("_fl")))
    vec = assemble(parts, width=width, as_double=as_double, strict=strict)
    out = df.withColumn("vec", vec).drop("codes", "_pep", "_fl")
    if not strict:
        out = out.withColumn("vec", F.when(F.exists("vec", lambda x: x.isNull()), F.lit(None))
                             .otherwise(F.col("vec")))
    return out


def encode_examples_checked(seqs: DataFrame, sample_codes: DataFrame, variant: str = "base",
                            seq_col: str = "seq", key: str = "sample_id",
                            abundance_col: str = "abundance",
                            flank_col: str = "flank") -> tuple[DataFrame, DataFrame]:
    """Reject mode of :func:`encode_examples`: (good rows with ``vec``, rejected
    rows with ``reason``) instead of failing the job.

    Reasons, first match wins: ``unknown_sample`` (no allele codes), ``null_input``
    (a NULL sequence, abundance or flank that the variant needs),
    ``unknown_letter`` (a letter outside the alphabet), ``bad_width`` (a
    sequence longer than 11 or a flank of the wrong length). Both outputs come
    from one lazy plan; persist it or write both when the input is costly.
    """
    from epiframe.plans.joins import sized_broadcast

    width = VARIANT_WIDTH[variant]
    dim = sized_broadcast(sample_codes.select(key, "codes"))
    df = seqs.join(dim, key, "left")
    letters = encode_letters(F.col(seq_col), strict=False)
    parts = [F.col("_pep"), F.col("codes")]
    as_double = variant != "base"
    if variant in ("abundance", "flank"):
        parts.append(F.array(F.col(abundance_col).cast("double")))
    staged = df.withColumn("_pep", pad_middle(letters, PEPTIDE_WIDTH))
    if variant == "flank":
        staged = staged.withColumn("_fl", encode_letters(F.col(flank_col), strict=False))
        parts.append(F.col("_fl"))
    vec = assemble(parts, as_double=as_double)
    unknown_letter = F.exists(F.col("_pep"), lambda x: x.isNull())
    if variant == "flank":
        unknown_letter = unknown_letter | F.exists(F.col("_fl"), lambda x: x.isNull())
    missing = F.col(seq_col).isNull()
    if variant in ("abundance", "flank"):
        missing = missing | F.col(abundance_col).isNull()
    if variant == "flank":
        missing = missing | F.col(flank_col).isNull()
    reason = (F.when(F.col("codes").isNull(), F.lit("unknown_sample"))
              .when(missing, F.lit("null_input"))
              .when(unknown_letter, F.lit("unknown_letter"))
              .when(F.size(vec) != F.lit(width), F.lit("bad_width")))
    checked = staged.withColumn("reason", reason)
    good = (checked.filter(F.col("reason").isNull())
            .withColumn("vec", vec).drop("codes", "_pep", "_fl", "reason"))
    rejects = checked.filter(F.col("reason").isNotNull()).drop("codes", "_pep", "_fl")
    return good, rejects
