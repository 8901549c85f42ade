"""Operator 11: how far the sources of a language differ in their words.

1. Every task folds whole documents into hash stripes in memory: term -> (document
   frequency, count) by source. When the stripes reach ``MAX_ENTRIES`` entries or
   ``MAX_KEY_BYTES`` of terms they are spilled as rows and the task starts afresh, so
   its memory is bounded whatever the texts hold.
2. Spilled stripes meet by (language, term) in one shuffle and are merged there. Terms
   in fewer than ``min_df`` documents of the language go.
3. The totals of the merged stripes give every group its smoothed probabilities; the
   stripes then emit the divergences directly. A term that a source lacks has the
   source's least probability p0, so a pair of sources needs no dense term list:

       sum f(p, q) = V f(p0, q0) + terms of the one + terms of the other + common terms

   where the second and third sum run over counts per (source, p) and only the last
   one meets sources within a stripe, added up in numpy in the task.

All arithmetic is on whole numbers. The number of rows returned for a language is the
square of its number of sources, which bounds every table of sources used here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, prepare_python, table
from epiframe.plans.joins import sized_broadcast

MIN_DF = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
MAX_ENTRIES = 300_000       # (term, language, source) entries a task holds
MAX_KEY_BYTES = 64 << 20    # bytes of the terms a task holds
LONG_TEXT = 4 << 20         # texts beyond this are counted match by match
MAX_PAIRS = 1 << 21         # source pairs a kernel holds before adding up

# Letters of ASCII and every character beyond it, as UTF-8 bytes; texts are lower-cased
# bytewise before, which changes A-Z alone.
TERM = re.compile(rb"[a-z\x80-\xff]+")

_ENTRY = "array<struct<source:string,n:bigint,df:bigint>>"


def fold_stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, entries): stripes of the documents, one row a spill and term.

    The empty term marks every (language, source) that has documents; its ``df`` counts
    them and its ``n`` is 0. NULL text, language and source are read as ''.
    """
    prepare_python(docs.sparkSession)

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        counts: dict[tuple[str, str], Counter] = {}
        freq: dict[tuple[str, str], Counter] = {}
        entries = key_bytes = 0

        def spill():
            stripes: dict[tuple[str, bytes], list] = {}
            for (lg, src), found in counts.items():
                df = freq[lg, src]
                for term, n in found.items():
                    stripes.setdefault((lg, term), []).append((src, n, df[term]))
            keys = list(stripes)
            for at in range(0, len(keys), 20_000):
                part = keys[at:at + 20_000]
                flat = [e for k in part for e in stripes[k]]
                ends = [0]
                for k in part:
                    ends.append(ends[-1] + len(stripes[k]))
                value = pa.StructArray.from_arrays(
                    [pa.array([e[0] for e in flat], pa.string()), pa.array([e[1] for e in flat], pa.int64()),
                     pa.array([e[2] for e in flat], pa.int64())], names=["source", "n", "df"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in part], pa.string()),
                     pa.array([k[1] for k in part], pa.binary()).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value)],
                    names=["lang", "term", "entries"])
            counts.clear()
            freq.clear()

        for b in batches:
            col = b.column(2)
            raw = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            for lg, src, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw):
                data = body.as_buffer()
                low = (data.to_pybytes() if data is not None else b"").lower()
                group = (lg, src)
                if group not in counts:
                    counts[group], freq[group] = Counter({b"": 0}), Counter()
                    entries += 1
                mine, docs_with = counts[group], freq[group]
                docs_with[b""] += 1
                if len(low) > LONG_TEXT:
                    own = Counter(m.group() for m in TERM.finditer(low))
                    before = len(mine)
                    for term, n in own.items():
                        mine[term] += n
                    distinct = own.keys()
                else:
                    found = TERM.findall(low)
                    distinct = set(found)
                    before = len(mine)
                    mine.update(found)
                docs_with.update(distinct)
                grown = len(mine) - before
                if grown:
                    entries += grown
                    key_bytes += min(len(low), grown * max(map(len, distinct)))
                if entries >= MAX_ENTRIES or key_bytes >= MAX_KEY_BYTES:
                    yield from spill()
                    entries = key_bytes = 0
        yield from spill()

    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
            for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*cols).mapInArrow(run, f"lang string, term string, entries {_ENTRY}")


def merged_stripes(docs: DataFrame, min_df: int = MIN_DF, text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """(lang, term, n, df, entries): one stripe a term of at least ``min_df`` documents
    of its language, and the empty terms of :func:`fold_stripes`.

    Spilled stripes are dealt by (lang, term) once; a source's entries of a term are
    added there, and then the sources of the term.
    """
    dealt = fold_stripes(docs, text, lang, source).repartition("lang", "term")
    one = dealt.select("lang", "term", F.inline("entries")).groupBy("lang", "term", "source") \
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    stripes = one.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return stripes.where((F.col("term") == "") | (F.col("df") >= min_df))


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), in two long divisions that stay within 64
    bits up to 9e13 occurrences."""
    a = F.lit(100_000) * (count + 1)
    quotient, rest = F.call_function("div", a, total), a % total
    low = F.lit(SCALE // 100_000)
    return low * quotient + F.call_function("div", low * rest, total) + 1


def deviation(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _common_terms(stripes: DataFrame) -> DataFrame:
    """(lang, s, t, v): over the stripes' pairs of different sources, what f(p, q) has
    beyond f(p, q0) + f(p0, q) - f(p0, q0). A task adds up in numpy and emits a row a
    pair; ``MAX_PAIRS`` bounds what it holds."""
    prepare_python(stripes.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        held: dict[str, list] = {}
        size = 0

        def add_up(parts):
            key = np.concatenate([k for k, _ in parts])
            val = np.concatenate([v for _, v in parts])
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[first], np.add.reduceat(val, first)

        def f(p, q):
            return (p - q) * (p - q) // q

        def pairs(lens, start, idx, p, p0):
            """Every ordered pair within each list, at most MAX_PAIRS at a time."""
            n = np.repeat(lens, lens)                  # partners of each entry
            base = np.repeat(start, lens)
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + MAX_PAIRS, "right")))
                a = np.repeat(np.arange(at, to), n[at:to])
                step = np.arange(len(a)) - np.repeat(ends[at:to] - n[at:to] - done, n[at:to])
                b = base[a] + step
                a, b = a[a != b], b[a != b]
                v = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                yield idx[a] << np.int64(32) | idx[b], v
                at = to

        def rows(lang):
            key, val = add_up(held.pop(lang))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(key), pa.string()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF),
                 pa.array(val)], names=["lang", "s", "t", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            langs = b.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            lists = b.column(1)
            lens = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            idx, p, p0 = (flat.field(i).to_numpy() for i in range(3))
            start = np.cumsum(lens) - lens
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(code == c)
                where = np.concatenate([np.arange(start[i], start[i] + lens[i]) for i in own])
                own_lens = lens[own]
                for part in pairs(own_lens, np.cumsum(own_lens) - own_lens, idx[where], p[where], p0[where]):
                    if len(part[0]):
                        held.setdefault(lang, []).append(part)
                        size += len(part[0])
                    if size >= 2 * MAX_PAIRS:
                        held = {k: [add_up(v)] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size >= MAX_PAIRS:
                            for k in list(held):
                                yield rows(k)
                            size = 0
        for k in list(held):
            yield rows(k)

    return stripes.select("lang", "entries").mapInArrow(run, "lang string, s long, t long, v long")


def source_divergences(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS, text: str = "text",
                       lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs``.

    Part ``pair``: the other sources of the language by their divergence from the group,
    all ranks. Part ``term``: the terms that the group uses more than its language does,
    by their share of that divergence, ``top`` ranks. Ties go to the item first in byte
    order. NULL text, language and source count as ''; a group without terms, and a
    language whose terms are all too rare (V = 0), still have their pair rows; a
    language of one source has none. Equal rows count as often as they occur. An empty
    table gives no rows. Columns but the three named are not looked at, so their names
    cannot clash. Texts are read whole; a long one is split over spills by its terms.
    """
    stripes = materialise(merged_stripes(docs, min_df, text, lang, source), "divergence-stripes")
    entries = stripes.select("lang", "term", "df", F.col("n").alias("lang_n"), F.inline("entries"))
    per_lang = stripes.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                           F.count(F.when(F.col("term") != "", 1)).alias("v"))
    named = entries.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(per_lang, "lang")
    # V = 0: no terms, nothing is ever divided
    total = F.greatest(F.col("total") + F.col("v"), F.lit(1))
    groups = materialise(named.select(
        "lang", "source", "v",
        F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("s"),
        total.alias("whole"), F.greatest(F.col("lang_total") + F.col("v"), F.lit(1)).alias("lang_whole"),
        probability(F.lit(0).cast("long"), total).alias("p0")), "divergence-groups")
    known = sized_broadcast(groups)
    seen = entries.where("term <> ''").join(known, ["lang", "source"]).select(
        "lang", "source", "s", "term", "p0", probability(F.col("n"), F.col("whole")).alias("p"),
        probability(F.col("lang_n"), F.col("lang_whole")).alias("q"))

    terms = seen.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       deviation(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # every ordered pair of sources of a language: the rows that are returned
    other = groups.select("lang", F.col("s").alias("t"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    level = deviation(F.col("p0"), F.col("q0"))
    base = groups.join(sized_broadcast(other), "lang").where("s <> t") \
        .select("lang", "s", "t", (F.col("v") * level).alias("v"))
    counted = seen.groupBy("lang", "s", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    single = counted.join(sized_broadcast(other.drop("item")), "lang").where("s <> t").select("lang", F.inline(F.array(
        F.struct(F.col("s"), F.col("t"), (F.col("m") * (deviation(F.col("p"), F.col("q0")) - level)).alias("v")),
        F.struct(F.col("t").alias("s"), F.col("s").alias("t"),
                 (F.col("m") * (deviation(F.col("q0"), F.col("p")) - deviation(F.col("q0"), F.col("p0")))).alias("v")))))
    common = _common_terms(seen.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p", "p0")).alias("entries")))
    sums = base.unionByName(single).unionByName(common).groupBy("lang", "s", "t").agg(F.sum("v").alias("value"))
    pairs = sums.join(sized_broadcast(groups.select("lang", "s", "source")), ["lang", "s"]) \
        .join(sized_broadcast(other.select("lang", "t", "item")), ["lang", "t"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(table(spark, sf_dir, "documents"))


OP11_ORACLE = r"""
with d as materialized (
  select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as materialized (select lang, term, count(*) n from w group by all having count(distinct id) >= 3),
c as materialized (select w.lang, w.source, w.term, count(*) n from w join kept using (lang, term) group by all),
v as (select lang, count(*) v, sum(n)::bigint total from kept group by lang),
g as materialized (
  select lang, source, coalesce(any_value(v.v), 0)::bigint v, any_value(v.total) lang_total,
         coalesce((select sum(n) from c where c.lang = x.lang and c.source = x.source), 0)::bigint total
  from (select distinct lang, source from d) x left join v using (lang) group by lang, source),
p as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n,
         1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + g.v) p,
         1 + 1000000000 * (k.n + 1) // (g.lang_total + g.v) q
  from g join kept k using (lang) left join c using (lang, source, term)),
pair as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint s
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0)::bigint "value"
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, "value", rank from (
  select *, row_number() over (partition by lang, source, part order by "value" desc, item)::integer rank from rows)
where part = 'pair' or rank <= 200
"""
