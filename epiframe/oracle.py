"""DuckDB twins of the stand-ins and helpers to write cross-check SQL.

These strings are used only to cross-check the Spark queries on small scale
factors. CTEs over the derived sequences are MATERIALIZED because the DuckDB
build in use fails on some plans that join an unnested CTE to an aggregate.
"""

from __future__ import annotations

from epiframe.functions.alphabet import PEPTIDE_WIDTH, RESIDUE_CODES
from epiframe.standins import N_SEQ_SAMPLES, SEQ_PATTERN, SLOT_NAMES, SLOTS_PER_SAMPLE, WORD_PATTERN

# Letters with codes 1..22 in code order; Z (0) is handled apart.
_CODED = "".join(k for k, v in sorted(RESIDUE_CODES.items(), key=lambda kv: kv[1]) if v > 0)
_ALPHA_CLASS = "[^" + "".join(sorted(RESIDUE_CODES)) + "]"

SEQ = f"""
select cast(doc_id as bigint) doc_id, cast(pos as integer) pos, upper(w) seq,
       cast(doc_id % {N_SEQ_SAMPLES} as bigint) sample_id, cast(quality as integer) label,
       cast(n_chars / 1000.0::double as double) abundance, cast(toxic as integer) toxic
from (select d.doc_id, l.quality, l.toxic, d.n_chars,
             unnest(regexp_extract_all(d.text, '{WORD_PATTERN}')) w,
             generate_subscripts(regexp_extract_all(d.text, '{WORD_PATTERN}'), 1) - 1 pos
      from documents d join labels l on d.doc_id = l.doc_id)
where regexp_matches(upper(w), '{SEQ_PATTERN}')
"""


def _fix(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '{_ALPHA_CLASS}', 'Z', 'g')"


SEQ_FLANK = f"""
select cast(doc_id as bigint) doc_id, cast(pos as integer) pos, upper(w) seq,
       cast(doc_id % {N_SEQ_SAMPLES} as bigint) sample_id, cast(quality as integer) label,
       cast(n_chars / 1000.0::double as double) abundance,
       lpad(right({_fix('prev')}, 5), 5, 'Z') || rpad(left({_fix('nxt')}, 5), 5, 'Z') flank
from (select doc_id, quality, n_chars, w, pos, ws[pos] prev, ws[pos + 2] nxt
      from (select d.doc_id, l.quality, d.n_chars, ws, unnest(ws) w,
                   generate_subscripts(ws, 1) - 1 pos
            from (select doc_id, n_chars, regexp_extract_all(text, '{WORD_PATTERN}') ws
                  from documents) d
            join labels l on d.doc_id = l.doc_id))
where regexp_matches(upper(w), '{SEQ_PATTERN}')
"""

VOC = """
select term, cast(row_number() over (order by term) as integer) code
from (select distinct p_brand term from part)
"""

CODES = f"""
select cast(p_partkey // {SLOTS_PER_SAMPLE} as bigint) sample_id, list_sort(list(code)) codes
from (select p_partkey, cast(dense_rank() over (order by p_brand) as integer) code from part)
group by 1
"""

SLOTS_WIDE = "select cast(p_partkey // {n} as bigint) sample_id, {cols} from part group by 1".format(
    n=SLOTS_PER_SAMPLE,
    cols=", ".join(f"max(case when p_partkey % {SLOTS_PER_SAMPLE} = {i} then p_brand end) \"{c}\""
                   for i, c in enumerate(SLOT_NAMES)))

SCORED = """
select doc_id, pos, sample_id, label, cast(length(seq) + instr(seq, 'E') as double) score from seq
"""


def code_of(ch: str) -> str:
    return f"(case when {ch} = 'Z' then 0 else instr('{_CODED}', {ch}) end)"


def letters(seq: str = "seq") -> str:
    return f"list_transform(string_split({seq}, ''), lambda c: {code_of('c')})"


def peptide(seq: str = "seq", width: int = PEPTIDE_WIDTH) -> str:
    k = f"length({seq})"
    left = code_of(f"substr({seq}, p + 1, 1)")
    right = code_of(f"substr({seq}, p - {width} + {k} + 1, 1)")
    return (f"list_transform(range({width}), lambda p: case when p < {k} // 2 then {left} "
            f"when p >= {width} - {k} + {k} // 2 then {right} else 0 end)")


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named stand-in CTEs (dependencies first)."""
    defs = {"seq": SEQ, "seqf": SEQ_FLANK, "voc": VOC, "codes": CODES, "slots": SLOTS_WIDE,
            "scored": SCORED}
    order = ["seq", "seqf", "voc", "codes", "slots", "scored"]
    want = set(names)
    if "scored" in want:
        want.add("seq")
    parts = [f"{n} as materialized ({defs[n]})" for n in order if n in want]
    return "with " + ",\n".join(parts) + "\n" + body if parts else body


def rule_sql(name: str, i: str, j: str | None = None) -> str:
    """SQL of :func:`epiframe.operators.scoring.rule_array` entry (i[, j])."""
    from epiframe.operators.scoring import RULES

    a, b, m, scale = RULES[name]
    inner = f"({a} * {i}" + (f" + {b} * {j}" if j is not None else "") + ")"
    return f"((({inner}) % {m}) - {m // 2}) / {scale}"
