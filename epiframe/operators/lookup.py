"""Dictionary look-ups: allele terms -> codes, samples -> code lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.plans.joins import sized_broadcast


def unpivot_slots(wide: DataFrame, id_col: str = "sample_id",
                  slot_cols: Sequence[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """Wide typing rows (id, slot1..slotN) -> (id, slot, term); NULL slots are dropped
    unless ``keep_empty``."""
    slot_cols = list(slot_cols or [c for c in wide.columns if c != id_col])
    long = wide.unpivot([id_col], slot_cols, "slot", "term")
    return long if keep_empty else long.filter(F.col("term").isNotNull())


def encode_slots(wide: DataFrame, vocab: DataFrame, id_col: str = "sample_id",
                 slot_cols: Sequence[str] | None = None, strict: bool = True,
                 allow_empty: bool = False) -> DataFrame:
    """Per sample, the ascending list of its allele codes, duplicates kept.

    ``vocab`` is (term, code). Sorting loses the locus order, as in the
    reference; a homozygous sample lists its code twice. An unknown term fails
    the job in ``strict`` mode and is left out otherwise (see :func:`unmatched_terms`);
    so does an empty (NULL) slot, unless ``allow_empty`` says that it carries no allele.
    A sample id that occurs on two rows fails in ``strict`` mode.
    """
    slot_cols = list(slot_cols or [c for c in wide.columns if c != id_col])
    long = unpivot_slots(wide, id_col, slot_cols, keep_empty=strict and not allow_empty)
    return encode_slot_terms(long, vocab, id_col, slot_col="slot", strict=strict)


def encode_slot_terms(long: DataFrame, vocab: DataFrame, id_col: str = "sample_id",
                      slot_col: str | None = None, strict: bool = True) -> DataFrame:
    """Long form of :func:`encode_slots`: rows (id, [slot,] term) -> (id, codes).

    With ``slot_col``, a slot filled twice for one id means the id occurs on two
    typing rows, which fails in ``strict`` mode.
    """
    voc = sized_broadcast(vocab.select("term", F.col("code").cast("int").alias("code")))
    cols = [id_col, "term"] + ([slot_col] if slot_col else [])
    joined = long.select(*cols).join(voc, "term", "left")
    code = F.col("code")
    if strict:
        code = F.when(code.isNull(), F.raise_error(
            F.concat(F.lit("unknown allele term: "), F.coalesce("term", F.lit("(empty slot)"))))).otherwise(code)
    else:
        joined = joined.filter(code.isNotNull())
    aggs = [F.sort_array(F.collect_list(code)).alias("codes")]
    if strict and slot_col:
        # per sample at most one row per slot column: a bounded set
        aggs.append((F.count(F.lit(1)) - F.size(F.collect_set(slot_col))).alias("_dup"))
    out = joined.groupBy(id_col).agg(*aggs)
    if strict and slot_col:
        out = out.select(id_col, F.when(
            F.col("_dup") > 0,
            F.raise_error(F.concat(F.lit("sample listed more than once: "),
                                   F.col(id_col).cast("string")))).otherwise(F.col("codes"))
            .alias("codes"))
    return out


def unmatched_terms(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """The (id, term) rows whose term is not in the vocabulary (the rows that
    would raise in strict mode)."""
    return long.join(sized_broadcast(vocab.select("term")), "term", "left_anti")


def attach_sample_codes(examples: DataFrame, sample_codes: DataFrame,
                        key: str = "sample_id", strict: bool = True) -> DataFrame:
    """Inner equi-join example.sample_id -> codes.

    ``sample_codes`` is one row per sample (bounded by the number of donors), so
    it is broadcast when its size check passes and the example side is never
    shuffled. A sample without codes fails the job in ``strict`` mode; otherwise
    its rows are dropped (use :func:`unmatched_samples` to report them).
    """
    dim = sized_broadcast(sample_codes.select(key, "codes"))
    if strict:
        joined = examples.join(dim, key, "left")
        return joined.withColumn("codes", F.when(
            F.col("codes").isNull(),
            F.raise_error(F.concat(F.lit("no allele codes for sample: "),
                                   F.col(key).cast("string")))).otherwise(F.col("codes")))
    return examples.join(dim, key, "inner")


def unmatched_samples(examples: DataFrame, sample_codes: DataFrame,
                      key: str = "sample_id") -> DataFrame:
    return examples.join(sized_broadcast(sample_codes.select(key)), key, "left_anti")
