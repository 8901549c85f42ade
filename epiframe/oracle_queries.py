"""DuckDB twins of the registered queries (see ``epiframe.registry``)."""

from __future__ import annotations

from epiframe import oracle as O
from epiframe.oracle import rule_sql as R
from epiframe.functions.alphabet import RESIDUE_CODES
from epiframe.functions.random import (FIELD_HIGH, FIELD_STEP, FIELD_UNIT, MASK32, MIX_LAST_SHIFT, MIX_STEPS, PRIME,
                                       ROUND_FACTORS, keep_threshold)
from epiframe.operators.scoring import ScorerConfig, _shapes
from epiframe.registry import (BATCH_PER_CLASS, EXACT_FRACTION, FIRST_EPOCH, FIT_RATE, FRACTION, KEEP, KNOWN_BELOW,
                               LAST_EPOCH, MASK_STEPS, MASK_UNITS, N_EXPECTED, N_TEST_SAMPLES, NOT_EXPECTED, OFF_KINK,
                               SCORE_BINS, SCORE_HIGH, SCORE_LOW, SEED, SEQUENTIAL_ROWS, SMALL_HIDDEN, SPLIT_SQL)
from epiframe.functions.encode import STRIP_PATTERN
from epiframe.standins import SLOT_NAMES

W = O.with_ctes


def _metrics_sql(src: str, by: str | None) -> str:
    """n_pos, n_neg, roc_auc, pr_auc, log_loss of (label, score) rows in ``src``."""
    g = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    grp = f"group by {by}" if by else ""
    return f"""
s as (select {g}score, sum(label) pos, count(*) - sum(label) neg from {src} group by {g}score),
c as (select *, sum(pos) over w cpos, sum(neg) over w cneg from s
      window w as ({part}order by score desc rows between unbounded preceding and current row)),
t as (select {g}score, pos::double pos, neg::double neg, cpos::double cpos, cneg::double cneg,
             (cpos + cneg)::double p1, (cpos + cneg - pos - neg)::double p0,
             (cpos - pos)::double tp0 from c)
select {g}cast(sum(pos) as bigint) n_pos, cast(sum(neg) as bigint) n_neg,
  round(case when sum(pos) > 0 and sum(neg) > 0
        then (sum(pos) * sum(neg) - sum(pos * cneg) + 0.5 * sum(pos * neg)) / (sum(pos) * sum(neg))
        else 0 end, 6) roc_auc,
  round(case when sum(pos) > 0 then sum(pos / (pos + neg) * (pos + (tp0 - pos / (pos + neg) * p0)
        * ln(case when p0 > 0 and p1 > 0 then p1 / p0 else 1 end))) / sum(pos) else 0 end, 6) pr_auc,
  round(sum(pos * (greatest(score, 0) - score + ln(1 + exp(-abs(score))))
            + neg * (greatest(score, 0) + ln(1 + exp(-abs(score))))) / (sum(pos) + sum(neg)), 6) log_loss
from t {grp}
"""


def _model_ctes(variant: str) -> str:
    """CTEs ex, hid, kc, lg (+ extra) for the masked scorer with rule weights."""
    depth = 23 if variant == "flank" else 21
    src = "seqf" if variant == "flank" else "seq"
    flank_col = ", s.flank" if variant == "flank" else ""
    ctes = [f"""ex as materialized (select s.doc_id, s.pos, s.sample_id, s.label, s.abundance{flank_col},
        {O.peptide('s.seq')} pep, c.codes from {src} s join codes c on s.sample_id = c.sample_id)""",
            "pp as (select doc_id, pos, unnest(range(11)) p, unnest(pep) code from ex)",
            f"""hid as materialized (select doc_id, pos, j,
        greatest({R('b1', 'j')} + sum({R('W1', f'(p * {depth} + code)', 'j')}), 0) h
        from pp, range(256) t(j) where code >= 0 and code < {depth} group by doc_id, pos, j)""",
            """kc as materialized (select doc_id, pos, c - 1 k, count(*) cnt
        from (select doc_id, pos, unnest(codes) c from ex) where c between 1 and 100 group by all)"""]
    extra = []
    if variant in ("abundance", "flank"):
        ctes.append(f"""ab as materialized (select doc_id, pos,
            sum(greatest(abundance * {R('A1', '0', 'j')} + {R('a1', 'j')}, 0) * {R('A2', 'j', '0')})
            + {R('a2', '0')} t from ex, range(16) t(j) group by doc_id, pos)""")
        extra.append("ab")
    if variant == "flank":
        ctes.append(f"""fp as (select doc_id, pos, unnest(range(10)) p,
            unnest({O.letters('flank')}) code from ex)""")
        ctes.append(f"""fh as (select doc_id, pos, j,
            greatest({R('f1', 'j')} + sum({R('F1', f'(p * {depth} + code)', 'j')}), 0) h
            from fp, range(32) t(j) where code >= 0 and code < {depth} group by doc_id, pos, j)""")
        ctes.append(f"""fl as materialized (select doc_id, pos, sum(h * {R('F2', 'j', '0')}) + {R('f2', '0')} t
            from fh group by doc_id, pos)""")
        extra.append("fl")
    add = "".join(f" + coalesce(max({e}.t), 0)" for e in extra)
    joins = "".join(f" left join {e} on {e}.doc_id = kc.doc_id and {e}.pos = kc.pos" for e in extra)
    ctes.append(f"""lg as materialized (select kc.doc_id, kc.pos, kc.k, kc.cnt,
        sum(hid.h * {R('W2', 'hid.j', 'kc.k')}) + {R('b2', 'kc.k')}{add} z
        from kc join hid on kc.doc_id = hid.doc_id and kc.pos = hid.pos{joins}
        group by kc.doc_id, kc.pos, kc.k, kc.cnt)""")
    ctes.append("""sc as (select doc_id, pos, sum(cnt / (1 + exp(-z))) score from lg group by doc_id, pos)""")
    return ",\n".join(ctes)


def _model_score_sql(variant: str) -> str:
    deps = ("seqf", "codes") if variant == "flank" else ("seq", "codes")
    body = (", " + _model_ctes(variant) + """
select ex.doc_id, ex.pos, ex.sample_id, ex.label, round(coalesce(sc.score, 0), 6) score
from ex left join sc on ex.doc_id = sc.doc_id and ex.pos = sc.pos""")
    return W(body, *deps).replace("\n, ", ",\n", 1)


def _with(deps: tuple, *ctes_and_body: str) -> str:
    """WITH <stand-ins>, <extra ctes> <body>."""
    head = W("", *deps).rstrip()
    rest = list(ctes_and_body)
    body = rest.pop()
    if rest:
        head += ",\n" + ",\n".join(rest)
    return head + "\n" + body


_PEP = O.peptide("s.seq")
_JOIN = "from seq s join codes c on s.sample_id = c.sample_id"
_HASH60 = "cast('0x' || substr(md5({k}), 1, 15) as bigint)"
_HASH32 = "cast('0x' || substr(md5({k}), 1, 8) as bigint)"
_LKEY = "concat_ws('|', l_orderkey, l_linenumber{seed})"
_UNSPLIT = "seq || chr(9) || cast(abundance as varchar) || chr(9) || cast(label + toxic as varchar)"
_LINES = ("select doc_id, cast(generate_subscripts(ls, 1) - 1 as integer) line_no, unnest(ls) l "
          "from (select doc_id, string_split(text, chr(10)) ls from documents)")
_UNPIVOT = ("select sample_id, slot, term from (unpivot slots on {cols} into name slot value term) "
            "where term is not null").format(cols=", ".join(f'"{c}"' for c in SLOT_NAMES))


def _masked_full() -> str:
    return _model_score_sql("base")


def _eval_model_sql(where: str = "") -> str:
    base = _model_score_sql("base")
    # wrap: model scores as a CTE, then the per-sample metrics
    head, _, _ = base.partition("\nselect ex.doc_id")
    scored = ("scored_m as materialized (select ex.doc_id, ex.pos, ex.sample_id, ex.label, "
              "round(coalesce(sc.score, 0), 9) score from ex left join sc "
              f"on ex.doc_id = sc.doc_id and ex.pos = sc.pos {where})")
    return head + ",\n" + scored + ",\n" + _metrics_sql("scored_m", "sample_id").strip()


def _figures_sql() -> str:
    head, _, _ = _model_score_sql("base").partition("\nselect ex.doc_id")
    values = {"n_rows": "count(*)", "n_pos": "sum(label)", "n_neg": "sum(1 - label)",
              "log_loss": "avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score))))",
              "least_score": "min(score)", "largest_score": "max(score)", "n_bad": "sum(0)"}
    rows = " union all ".join(f"select '{k}' figure, round(cast({v} as double), 6) observed, "
                              f"round(cast({v} as double), 6) recounted from scored_m" for k, v in values.items())
    return head + """,
scored_m as materialized (select ex.label, coalesce(sc.score, 0) score from ex left join sc
    on ex.doc_id = sc.doc_id and ex.pos = sc.pos)
select * from (""" + rows + ")"


def _gradient_sql() -> str:
    base = _model_score_sql("base")
    head, _, _ = base.partition("\nselect ex.doc_id")
    return head + """,
g as (select lg.k, sum((1 / (1 + exp(-sc.score)) - ex.label) * lg.cnt
        * (1 / (1 + exp(-lg.z))) * (1 - 1 / (1 + exp(-lg.z)))) g
      from lg join sc on lg.doc_id = sc.doc_id and lg.pos = sc.pos
      join ex on lg.doc_id = ex.doc_id and lg.pos = ex.pos group by lg.k)
select cast(r.range as integer) k, round(coalesce(g.g, 0), 6) g from range(100) r
left join g on g.k = r.range"""


def _weights_cte(variant: str, hidden: int) -> str:
    """Rule weights as rows: w0(name, i, j, v)."""
    parts = []
    for name, shape in _shapes(ScorerConfig(variant, hidden=hidden)).items():
        n, m = (*shape, 1) if len(shape) == 1 else shape
        value = R(name, "i") if len(shape) == 1 else R(name, "i", "j")
        value += f" + {OFF_KINK.get(name, 0)}"
        parts.append(f"select '{name}' name, i, j, ({value})::double v from range({n}) a(i), range({m}) b(j)")
    return "w0 as materialized (" + " union all ".join(parts) + ")"


def _examples_ctes(variant: str) -> list[str]:
    src, flank = ("seqf", ", s.flank") if variant == "flank" else ("seq", "")
    depth = ScorerConfig(variant).depth
    out = [f"""ex as materialized (select s.doc_id, s.pos, s.label, s.abundance{flank}, {O.peptide('s.seq')} pep, c.codes
        from {src} s join codes c on s.sample_id = c.sample_id)""",
           f"""pp as materialized (select doc_id, pos, p * {depth} + code i from (
        select doc_id, pos, unnest(range(11)) p, unnest(pep) code from ex) where code >= 0 and code < {depth})""",
           """kc as materialized (select doc_id, pos, c - 1 k, count(*) cnt
        from (select doc_id, pos, unnest(codes) c from ex) where c between 1 and 100 group by all)"""]
    if variant == "flank":
        out.append(f"""pf as materialized (select doc_id, pos, p * {depth} + code i from (
        select doc_id, pos, unnest(range(10)) p, unnest({O.letters('flank')}) code from ex)
        where code >= 0 and code < {depth})""")
    return out


def _pass_ctes(variant: str, t: int) -> list[str]:
    """Forward and backward pass with the weights ``w{t}``, as joins of sparse one-hot
    rows with weight rows and grouped sums; ends in s{t} (score), g{t} (gradient sums)."""
    def w(name: str) -> str:
        return f"(select i, j, v from w{t} where name = '{name}')"

    def hidden(table: str, rows: str, first: str, bias: str) -> str:
        return f"""{table}{t} as materialized (select r.doc_id, r.pos, w.j, sum(w.v) + any_value(b.v) pre
        from {rows} r join {w(first)} w using (i) join {w(bias)} b on b.i = w.j group by r.doc_id, r.pos, w.j)"""
    out = [hidden("h", "pp", "W1", "b1")]
    extra = []
    if variant != "base":
        out.append(f"""a{t} as materialized (select doc_id, pos, w.j, abundance * w.v + b.v pre, abundance
        from ex, {w('A1')} w join {w('a1')} b on b.i = w.j)""")
        extra.append(("a", "A"))
    if variant == "flank":
        out.append(hidden("f", "pf", "F1", "f1"))
        extra.append(("f", "F"))
    for tab, name in extra:
        out.append(f"""{tab}z{t} as (select doc_id, pos, sum(greatest(pre, 0) * w.v) + (select v from {w(name.lower() + '2')}) z
        from {tab}{t} x join {w(name + '2')} w on w.i = x.j group by doc_id, pos)""")
    add = "".join(f" + coalesce(any_value({tab}z{t}.z), 0)" for tab, _ in extra)
    joins = "".join(f" left join {tab}z{t} on {tab}z{t}.doc_id = kc.doc_id and {tab}z{t}.pos = kc.pos" for tab, _ in extra)
    out += [f"""z{t} as materialized (select kc.doc_id, kc.pos, kc.k, any_value(kc.cnt) cnt,
        sum(greatest(h.pre, 0) * w.v) + any_value(b.v){add} z
        from kc join h{t} h on h.doc_id = kc.doc_id and h.pos = kc.pos join {w('W2')} w on w.i = h.j and w.j = kc.k
        join {w('b2')} b on b.i = kc.k{joins} group by kc.doc_id, kc.pos, kc.k)""",
            f"""s{t} as materialized (select ex.doc_id, ex.pos, ex.label, coalesce(sum(cnt / (1 + exp(-z))), 0) score
        from ex left join z{t} z on z.doc_id = ex.doc_id and z.pos = ex.pos group by all)""",
            f"""d{t} as materialized (select z.doc_id, z.pos, k, (1 / (1 + exp(-score)) - label) * cnt
        * (1 / (1 + exp(-z))) * (1 - 1 / (1 + exp(-z))) g from z{t} z join s{t} s on s.doc_id = z.doc_id and s.pos = z.pos)""",
            f"""e{t} as materialized (select doc_id, pos, sum(g) g from d{t} group by all)""",
            f"""hd{t} as materialized (select h.doc_id, h.pos, h.j, sum(d.g * w.v) g from h{t} h
        join d{t} d on d.doc_id = h.doc_id and d.pos = h.pos join {w('W2')} w on w.i = h.j and w.j = d.k
        where h.pre > 0 group by all)"""]
    grads = [f"""select 'W2' name, h.j i, d.k j, sum(greatest(h.pre, 0) * d.g) g from h{t} h
          join d{t} d on d.doc_id = h.doc_id and d.pos = h.pos group by all""",
             f"select 'b2', k, 0, sum(g) from d{t} group by k", f"select 'b1', j, 0, sum(g) from hd{t} group by j",
             f"""select 'W1', r.i, x.j, sum(x.g) from hd{t} x join pp r on r.doc_id = x.doc_id and r.pos = x.pos group by all"""]
    for tab, name in extra:
        low = name.lower()
        out.append(f"""{tab}d{t} as materialized (select x.doc_id, x.pos, x.j, e.g * w.v g from {tab}{t} x
        join e{t} e on e.doc_id = x.doc_id and e.pos = x.pos join {w(name + '2')} w on w.i = x.j where x.pre > 0)""")
        grads += [f"""select '{name}2', x.j, 0, sum(greatest(x.pre, 0) * e.g) from {tab}{t} x
          join e{t} e on e.doc_id = x.doc_id and e.pos = x.pos group by x.j""",
                  f"select '{low}2', 0, 0, sum(g) from e{t}", f"select '{low}1', j, 0, sum(g) from {tab}d{t} group by j"]
    if variant != "base":
        grads.append(f"""select 'A1', 0, x.j, sum(x.g * ex.abundance) from ad{t} x
          join ex on ex.doc_id = x.doc_id and ex.pos = x.pos group by x.j""")
    if variant == "flank":
        grads.append(f"""select 'F1', r.i, x.j, sum(x.g) from fd{t} x
          join pf r on r.doc_id = x.doc_id and r.pos = x.pos group by all""")
    out.append(f"""g{t} as materialized (select w.name, w.i, w.j, coalesce(g.g, 0) g, w.v from w{t} w left join ("""
               + "\n          union all ".join(grads) + ") g on g.name = w.name and g.i = w.i and g.j = w.j)")
    return out


def _gradients_sql(variant: str) -> str:
    deps = ("seqf" if variant == "flank" else "seq", "codes")
    return _with(deps, *_examples_ctes(variant), _weights_cte(variant, SMALL_HIDDEN), *_pass_ctes(variant, 0),
                 "select name, i::integer i, j::integer j, round(g, 4) + 0.0::double g from g0")


def _fit_losses_sql() -> str:
    """Adam's first step moves every weight by lr g / (|g| + eps), g the mean gradient."""
    loss = "round(sum(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))) / count(*), 6) loss, count(*) \"rows\""
    step = (f"w1 as materialized (select name, i, j, v - {FIT_RATE} * (g / n) / (abs(g / n) + 1e-8) v "
            "from g0, (select count(*) n from ex))")
    return _with(("seq", "codes"), *_examples_ctes("base"), _weights_cte("base", SMALL_HIDDEN), *_pass_ctes("base", 0),
                 step, *[c for c in _pass_ctes("base", 1) if not c.startswith(("d1", "e1", "hd1", "g1"))],
                 f"select 0 step, {loss} from s0 union all select 1, {loss} from s1")


def _let(value: str, *bodies: str) -> str:
    """Each body is an expression of ``v``, the value of the one before."""
    out = f"[{value}]"
    for b in bodies:
        out = f"list_transform({out}, lambda v: {b})"
    return out + "[1]"


def _mix32(x: str) -> str:
    steps = [f"(xor(v, v >> {s}) * {m}) & {MASK32}" for s, m in MIX_STEPS]
    return _let(x, *steps, f"xor(v, v >> {MIX_LAST_SHIFT})")


def _dropout_sql() -> str:
    key = _HASH60.format(k=f"concat_ws('|', doc_id, pos, '{SEED}')")
    return _with(("seq",), f"""r as materialized (select doc_id, pos, step, {key} h
  from seq, (select unnest([{', '.join(map(str, MASK_STEPS))}]) step))""",
                 f"hi as (select *, {_mix32(f'xor(h >> 32, {FIELD_HIGH})')} a from r)",
                 f"lo as (select *, {_mix32(f'xor(h & {MASK32}, a)')} b from hi)",
                 f"st as materialized (select *, xor(b, {_mix32(f'(step * 8 + {FIELD_STEP})::bigint')}) s from lo)",
                 f"un as materialized (select u, {_mix32(f'u * 8 + {FIELD_UNIT}')} m from range({MASK_UNITS}) t(u))",
                 f"""select doc_id, pos, u::integer unit, step::integer step,
  {_mix32('xor(s, m)')} < {keep_threshold(KEEP)} kept from st, un""")


def _permuted(x: str, walks: int = 6) -> str:
    """Place of x in the keyed order; columns n, ga, gb (grid) and pk (key)."""
    def turn(i: int, f: int) -> str:
        here, there, size = ("l", "r", "ga") if i % 2 == 0 else ("r", "l", "gb")
        y = f"((v.{there} + pk * {f} % {PRIME}) % {PRIME})"
        new = f"(v.{here} + {y} * {y} % {PRIME}) % {size}"
        return "{'l': " + (new if here == "l" else "v.l") + ", 'r': " + (new if here == "r" else "v.r") + "}"

    def once(v: str) -> str:
        return _let("{'l': " + f"{v} // gb, 'r': {v} % gb" + "}", *[turn(i, f) for i, f in enumerate(ROUND_FACTORS)],
                    "v.l * gb + v.r")
    return _let(x, once("v"), *[f"case when v < n then v else {once('v')} end"] * walks)


def _epoch_ctes() -> list[str]:
    return [f"""num as (select l_orderkey, l_linenumber, l_returnflag,
             row_number() over (partition by l_returnflag order by
               {_HASH60.format(k=_LKEY.format(seed=f", '{SEED}'"))}, l_orderkey, l_linenumber) rn,
             count(*) over (partition by l_returnflag) n from lineitem)""",
            f"""ep as (select *, floor(sqrt(n::double))::bigint + 1 ga, n // (floor(sqrt(n::double))::bigint + 1) + 1 gb,
             cast('0x' || substr(md5(concat_ws('|', '{SEED}', epoch, l_returnflag)), 1, 7) as bigint) pk
           from (select *, unnest(range(e0, e1 + 1)) epoch from rng))"""]


def _epoch_order_sql() -> str:
    num, ep = _epoch_ctes()
    return f"""with {num},
rng as (select *, {FIRST_EPOCH}::bigint e0, {LAST_EPOCH - 1}::bigint e1 from num),
{ep}
select epoch, {_permuted('rn - 1')} "position", l_returnflag, l_orderkey, l_linenumber from ep"""


def _epoch_batches_sql() -> str:
    num, ep = _epoch_ctes()
    b = BATCH_PER_CLASS
    return f"""with {num},
lim as (select (max(n) // {b}) * {b} lo, 3 * (max(n) // {b}) * {b} hi from num),
rng as (select num.*, lo, hi, lo // n e0, (hi - 1) // n e1 from num, lim where hi > lo),
{ep},
placed as (select *, epoch * n + {_permuted('rn - 1')} s from ep)
select cast(s // {b} as bigint) batch, cast(s % {b} as bigint) slot, epoch, l_returnflag, l_orderkey, l_linenumber
from placed where s >= lo and s < hi"""


def _binned_sql() -> str:
    width = (SCORE_HIGH - SCORE_LOW) / SCORE_BINS
    exact, sel = _metrics_sql("scored", "sample_id").strip().split("\nselect ", 1)
    def area(p, n, tp, fp):
        return (f"case when {p} > 0 then {p} / ({p} + {n}) * ({p} + ({tp} - {p} / ({p} + {n}) * ({tp} + {fp})) * "
                f"case when {tp} + {fp} > 0 then ln(({tp} + {fp} + {p} + {n}) / ({tp} + {fp})) else 0 end) else 0 end")
    zero = "0::double"
    return _with(("scored",), exact, "exact_m as (select " + sel.replace("round(case", "(case").replace(", 6) roc_auc", ") roc_auc")
                 .replace(", 6) pr_auc", ") pr_auc") + ")",
                 f"""bins as (select sample_id, least(greatest(floor((score - {SCORE_LOW}::double) / {width}::double), 0), {SCORE_BINS - 1})::integer bin,
  sum(label)::double bp, sum(1 - label)::double bn from scored group by all)""",
                 """cum as (select *, sum(bp) over w - bp tp, sum(bn) over w - bn fp, sum(bn) over w cn from bins
  window w as (partition by sample_id order by bin desc))""",
                 f"""ar as (select sample_id, sum(bp) p, sum(bn) n, sum(bp * cn) lost, sum(bp * bn) tied,
  sum({area('bp', 'bn', 'tp', 'fp')}) even, sum({area('bp', zero, 'tp', 'cn')}) worst, sum({area('bp', zero, 'tp', 'fp')}) best
  from cum group by 1)""",
                 """ans as (select sample_id, p, n, case when p > 0 and n > 0 then (p * n - lost + 0.5 * tied) / (p * n) else 0 end roc,
  case when p > 0 and n > 0 then 0.5 * tied / (p * n) else 0 end bound, case when p > 0 then even / p else 0 end pr,
  case when p > 0 then worst / p else 0 end low, case when p > 0 then best / p else 0 end high from ar)""",
                 """select sample_id, p::bigint n_pos, n::bigint n_neg, round(roc, 6) roc_auc, round(bound, 6) roc_bound,
  round(pr, 6) pr_auc, round(low, 6) pr_low, round(high, 6) pr_high,
  abs(roc - roc_auc) <= bound + 1e-9 roc_within, pr_auc between low - 1e-9 and high + 1e-9 pr_within
from ans join exact_m using (sample_id)""")


_STATUS = f"""exp_ as (select {SPLIT_SQL} split, 'sample_' || sample_id || '_' || cls file, cls
    from (select distinct (doc_id % {N_EXPECTED})::bigint sample_id from documents), (select unnest(['pos', 'neg']) cls)
    where sample_id not in {NOT_EXPECTED}),
  fnd as (select distinct {SPLIT_SQL} split, 'sample_' || sample_id || '_' || case when label = 1 then 'pos' else 'neg' end file,
    case when label = 1 then 'pos' else 'neg' end cls from seq),
  st as (select coalesce(e.split, f.split) split, coalesce(e.file, f.file) file, coalesce(e.cls, f.cls) cls,
    case when f.file is null then 'missing' when e.file is null then 'surplus' else 'present' end status
    from exp_ e full outer join fnd f on e.split = f.split and e.file = f.file)"""


ORACLE: dict[str, str] = {
    "encode_letters": W(f"select doc_id, pos, array_to_string({O.letters()}, ',') codes from seq", "seq"),
    "pad_middle": W(f"select doc_id, pos, array_to_string({O.peptide()}, ',') vec from seq", "seq"),
    "encode_slots": W("select sample_id, array_to_string(codes, ',') codes from codes", "codes"),
    "assemble17": W(f"""select s.doc_id, s.pos, s.sample_id, s.label,
        array_to_string(list_concat({_PEP}, c.codes), ',') vec {_JOIN}""", "seq", "codes"),
    "assemble18": W(f"""select s.doc_id, s.pos, s.sample_id, s.label,
        array_to_string(list_concat(cast({_PEP} as double[]), cast(c.codes as double[]),
                                    [s.abundance]), ',') vec {_JOIN}""", "seq", "codes"),
    "assemble28": W(f"""select s.doc_id, s.pos, s.sample_id, s.label,
        array_to_string(list_concat(cast({_PEP} as double[]), cast(c.codes as double[]),
                                    [s.abundance], cast({O.letters('s.flank')} as double[])), ',') vec
        from seqf s join codes c on s.sample_id = c.sample_id""", "seqf", "codes"),
    "one_hot": W(f"""select doc_id, pos, array_to_string(flatten(list_transform({O.peptide()},
        lambda c: list_transform(range(21), lambda d: case when c = d then 1 else 0 end))), ',') onehot
        from seq""", "seq"),
    "multi_hot": W("""select sample_id, array_to_string(list_transform(range(1, 101),
        lambda i: len(list_filter(codes, lambda x: x = i))), ',') counts from codes""", "codes"),
    "attach_codes": W(f"select s.doc_id, s.pos, s.sample_id, array_to_string(c.codes, ',') codes {_JOIN}",
                      "seq", "codes"),
    "unmatched_letters": """
select cast(doc_id as bigint) doc_id, cast(pos as integer) pos, upper(w) seq
from (select d.doc_id, unnest(regexp_extract_all(d.text, '[A-Za-z]+')) w,
             generate_subscripts(regexp_extract_all(d.text, '[A-Za-z]+'), 1) - 1 pos
      from documents d where d.doc_id in (select doc_id from labels))
where regexp_matches(upper(w), '^[A-Z]{8,11}$')
  and regexp_matches(upper(w), '[^ACDEFGHIKLMNOPQRSTUVWYZ]')
""",
    "encode_rejects": """
select doc_id, pos, seq, case when regexp_matches(seq, '[^ACDEFGHIKLMNOPQRSTUVWYZ]') then 'unknown_letter'
                              else 'bad_width' end reason
from (select cast(doc_id as bigint) doc_id, cast(pos as integer) pos, upper(w) seq
      from (select d.doc_id, unnest(regexp_extract_all(d.text, '[A-Za-z]+')) w,
                   generate_subscripts(regexp_extract_all(d.text, '[A-Za-z]+'), 1) - 1 pos
            from documents d where d.doc_id in (select doc_id from labels)))
where regexp_matches(seq, '^[A-Z]{6,13}$')
  and (regexp_matches(seq, '[^ACDEFGHIKLMNOPQRSTUVWYZ]') or length(seq) > 11)
""",
    "unmatched_terms": W(f"select * from ({_UNPIVOT}) u where term not in (select term from voc where term < '{KNOWN_BELOW}')",
                         "voc", "slots"),
    "slice_features": W(f"""select s.doc_id, s.pos,
        array_to_string(cast({_PEP} as double[]), ',') peptide,
        array_to_string(cast(c.codes as double[]), ',') alleles, round(s.abundance, 6) abundance
        {_JOIN}""", "seq", "codes"),
    "clean_lines": f"""
select doc_id, line_no, v as value
from (select doc_id, line_no, regexp_replace(l, '{STRIP_PATTERN}', '', 'g') v from ({_LINES}))
where v <> ''""",
    "split_pos": W(f"select doc_id, pos, {_UNSPLIT} as value from seq where label + toxic = 1", "seq"),
    "split_neg": W(f"select doc_id, pos, {_UNSPLIT} as value from seq where label + toxic = 0", "seq"),
    "class_counts": W("select sample_id, label, count(*) n from seq group by sample_id, label", "seq"),
    "sample_hash": f"""select l_orderkey, l_linenumber from lineitem
        where {_HASH32.format(k=_LKEY.format(seed=''))} % 1000000 < {int(round(FRACTION * 1e6))}""",
    "downsample_negatives": f"""select l_orderkey, l_linenumber, label from (
        select l_orderkey, l_linenumber, cast(l_returnflag = 'R' as integer) label from lineitem)
        where label <> 0 or {_HASH32.format(k=_LKEY.format(seed=f", '{SEED}'"))} % 1000000
              < {int(round(FRACTION * 1e6))}""",
    "balanced_batches": f"""
with r as (select l_orderkey, l_linenumber, l_returnflag,
             row_number() over (partition by l_returnflag order by
               {_HASH60.format(k=_LKEY.format(seed=f", '{SEED}'"))}, l_orderkey, l_linenumber) rn
           from lineitem),
cnt as (select l_returnflag, count(*) n from lineitem group by 1),
slots as (select l_returnflag, n, unnest(range(0, (select (max(n) + {BATCH_PER_CLASS - 1})
             // {BATCH_PER_CLASS} * {BATCH_PER_CLASS} from cnt))) s from cnt)
select cast(s // {BATCH_PER_CLASS} as bigint) batch, cast(s % {BATCH_PER_CLASS} as bigint) slot,
       slots.l_returnflag, r.l_orderkey, r.l_linenumber
from slots join r on slots.l_returnflag = r.l_returnflag and r.rn = slots.s % slots.n + 1""",
    "sequential_batches": W(f"""select sample_id, doc_id, pos, label, rn,
        cast((rn - 1) // {SEQUENTIAL_ROWS} as bigint) batch
        from (select *, row_number() over (partition by sample_id order by label, doc_id, pos) rn
              from seq)""", "seq"),
    "log_loss": W("""select round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 6)
        log_loss from scored""", "scored"),
    "activations": W("""select doc_id, pos, round(greatest(score - 15.0, 0), 6) relu,
        round(1 / (1 + exp(-(score - 15.0))), 6) sigmoid from scored""", "scored"),
    "linear": W(f"""select doc_id, pos, round(sum(greatest(abundance * {R('A1', '0', 'j')}
        + {R('a1', 'j')}, 0) * {R('A2', 'j', '0')}) + {R('a2', '0')}, 6) y
        from seq, range(16) t(j) group by doc_id, pos""", "seq"),
    "masked_score": _model_score_sql("base"),
    "masked_score_abundance": _model_score_sql("abundance"),
    "masked_score_flank": _model_score_sql("flank"),
    "eval_model": _eval_model_sql(),
    "eval_held_out": _eval_model_sql(f"where ex.sample_id < {N_TEST_SAMPLES}"),
    "scored_written": _model_score_sql("base"),
    "scored_figures": _figures_sql(),
    "gradient_sums": _gradient_sql(),
    "gradients_base": _gradients_sql("base"),
    "gradients_abundance": _gradients_sql("abundance"),
    "gradients_flank": _gradients_sql("flank"),
    "fit_losses": _fit_losses_sql(),
    "dropout_mask": _dropout_sql(),
    "epoch_order": _epoch_order_sql(),
    "epoch_batches": _epoch_batches_sql(),
    "binned_areas": _binned_sql(),
    "downsample_exact": f"""select l_orderkey, l_linenumber, label from (
        select *, row_number() over (partition by l_linenumber, label order by
            {_HASH60.format(k=_LKEY.format(seed=f", '{SEED}'"))}) r, count(*) over (partition by l_linenumber, label) n
        from (select l_orderkey, l_linenumber, cast(l_returnflag = 'R' as integer) label from lineitem))
        where label <> 0 or r <= (2 * n * {EXACT_FRACTION[0]} + {EXACT_FRACTION[1]}) // {2 * EXACT_FRACTION[1]}""",
    "sample_bernoulli_check": """select count(*) "rows", true each_once, true about_the_share,
        true same_with_same_seed from lineitem""",
    "slice_float32": W(f"""select s.doc_id, s.pos, {_PEP}[1]::float "first", c.codes[6]::float "last",
        s.abundance::float abundance {_JOIN}""", "seq", "codes"),
    "read_vocab": W("select term, code from voc", "voc"),
    "read_slots": W("select * from slots", "slots"),
    "read_labelled2": W(f"select seq, label, sample_id, {SPLIT_SQL} split from seq", "seq"),
    "read_labelled3": W(f"""select seq, round(abundance, 6) abundance, label, sample_id,
        {SPLIT_SQL} split from seq""", "seq"),
    "path_columns": W(f"""select {SPLIT_SQL} split, 'sample_' || sample_id sample, label path_label,
        count(*) n from seq group by all""", "seq"),
    "manifest": W(f"""select {SPLIT_SQL} split, 'sample_' || sample_id sample, cls,
        'sample_' || sample_id || '_' || cls file
        from (select distinct sample_id from seq), (select unnest(['pos', 'neg']) cls)""", "seq"),
    "manifest_missing": _with(("seq",), _STATUS, """select split, cls,
        count(*) filter (where status <> 'surplus') expected, count(*) filter (where status = 'present') present,
        count(*) filter (where status = 'missing') missing, count(*) filter (where status = 'surplus') surplus,
        0::bigint "empty", count(*) filter (where status = 'present') = count(*) exact from st group by split, cls"""),
    "manifest_files": _with(("seq",), _STATUS, "select split, file, cls, status from st where status <> 'present'"),
    "file_listing": W(f"""select {SPLIT_SQL} split, 'sample_' || sample_id || '_' || case when label = 1 then 'pos' else 'neg' end file,
        case when label = 1 then 'pos' else 'neg' end cls, sum(length(seq) + 3)::bigint bytes from seq group by all""", "seq"),
    "class_sets": W(f"""select s.doc_id, s.pos, s.sample_id, s.label,
        array_to_string(list_concat({_PEP}, c.codes), ',') vec {_JOIN}
        where s.sample_id >= {N_TEST_SAMPLES}""", "seq", "codes"),
    "sample_set": W(f"""select s.doc_id, s.pos, s.sample_id, s.label,
        array_to_string(list_concat({_PEP}, c.codes), ',') vec,
        row_number() over (partition by s.sample_id order by s.label, s.doc_id, s.pos) rn
        {_JOIN} where s.sample_id < {N_TEST_SAMPLES}""", "seq", "codes"),
    "examples_roundtrip": W(f"""select s.doc_id, s.pos, s.sample_id, s.label,
        case when s.sample_id < {N_TEST_SAMPLES} then 'test' else 'train' end split,
        array_to_string(list_concat({_PEP}, c.codes), ',') vec {_JOIN}""", "seq", "codes"),
    "dictionary_roundtrip": W("select 'samples' dictionary, sample_id::varchar \"key\", array_to_string(codes, ',') codes from codes "
                              "union all select 'vocab', term, code::varchar from voc union all "
                              "select 'residues', unnest([" + ", ".join(f"'{k}'" for k in RESIDUE_CODES) + "]), "
                              "unnest([" + ", ".join(f"'{v}'" for v in RESIDUE_CODES.values()) + "])", "voc", "codes"),
    "text_roundtrip": W(f"select {_UNSPLIT} as value from seq", "seq"),
}

_ctes, _sel = _metrics_sql("scored", None).strip().split("\nselect ", 1)
ORACLE["roc_auc"] = _with(("scored",), _ctes, "m as (select " + _sel + ")", "select roc_auc from m")
ORACLE["linear_arrow"] = ORACLE["linear"]
ORACLE["bucketed_codes"] = ORACLE["attach_codes"]
ORACLE["bucketed_batches"] = ORACLE["sequential_batches"]
ORACLE["vocab_versions"] = """
with found as (select p_brand term, 1 step from part union all select p_type, 2 from part union all select p_name, 3 from part),
     firsts as (select term, min(step) step from found where trim(term) <> '' group by term),
     coded as (select term, step, cast(row_number() over (order by step, term) as integer) code from firsts)
select cast(v.version as integer) as version, term, code
from coded, (select unnest([1, 2, 3]) as version) v where coded.step <= v.version"""
ORACLE["pr_auc"] = _with(("scored",), _ctes, "m as (select " + _sel + ")", "select pr_auc from m")
_ctes_s, _sel_s = _metrics_sql("scored", "sample_id").strip().split("\nselect ", 1)
ORACLE["eval_by_sample"] = _with(("scored",), _ctes_s, "select " + _sel_s)
