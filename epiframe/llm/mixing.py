"""Operator 9: mix sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). At every node it is
split among the children by weight; a child that cannot use its share is given
all it has and the shortage goes to its siblings first. Only when a whole subtree
is used up does its shortage reach the siblings of the parent, because a parent's
own share is capped by what its subtree holds before it is split. Each leaf then
takes the longest prefix, by tokens, of its documents in seeded epoch order.

All budget arithmetic is on integers (DECIMAL(38, 0)), so it is the same on any
engine and layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import materialise, table, words_of

BIG = "decimal(38,0)"
SLICES = 256  # order slices per leaf and epoch: the first two hex digits of the order hash


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """Seeded order of one epoch, the same in any engine that has md5."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("~"))))


def split_budget(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Water-fill each parent's ``budget`` over its children.

    ``nodes``: parent columns, ``name``, ``weight`` (long >= 0), ``cap`` (decimal),
    ``budget`` (decimal, the parent's). Children are taken in the order of
    cap / weight; one whose cap fits its share of what is left is used up, the
    first that does not fit ends the redistribution and the rest share by weight
    (rounded down). Weight 0 or cap 0 gets nothing. Returns ``nodes`` with
    ``share``.
    """
    # children by cap per unit of weight (millionths, rounded down), ties by name
    ratio = F.when(F.col("weight") > 0, F.expr(f"cast(cap as {BIG}) * 1000000 div weight")).cast(BIG)
    w = Window.partitionBy(*parent).orderBy("_ratio", name)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = nodes.withColumn("_ratio", ratio).where("weight > 0")
    live = live.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG)) \
        .withColumn("_w", F.sum("weight").over(after).cast(BIG))
    live = live.withColumn("_left", F.greatest(F.col("budget") - F.col("_used"), F.lit(0)).cast(BIG)) \
        .withColumn("_fits", F.expr("cast(cap as decimal(38,0)) * _w <= _left * weight"))
    # the first child that does not fit fixes the rate for all after it
    stop = F.max(F.when(~F.col("_fits"), F.struct(
        (-F.row_number().over(w)).alias("o"), F.col("_left").alias("l"), F.col("_w").alias("w")))) \
        .over(Window.partitionBy(*parent))
    staged = live.withColumn("_rn", F.row_number().over(w)).withColumn("_stop", stop)
    share = F.when(F.col("_stop").isNull() | (F.col("_rn") < -F.col("_stop.o")), F.col("cap")) \
        .otherwise(F.expr("least(cap, cast(_stop.l * weight div _stop.w as decimal(38,0)))"))
    return staged.withColumn("share", share.cast(BIG)) \
        .drop("_ratio", "_used", "_w", "_left", "_fits", "_rn", "_stop")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], budget: int, weight_of) -> DataFrame:
    """Walk the tree from the root: ``leaves`` has the level columns, ``supply`` and
    ``cap``; ``budget`` (at most the sum of caps) is the root's; ``weight_of(level,
    column)`` gives a node's integer weight. Returns leaves with ``budget`` (tokens
    to take)."""
    parents: DataFrame | None = None
    path: list[str] = []
    for level in levels:
        path.append(level)
        nodes = leaves.groupBy(*path).agg(F.sum("cap").cast(BIG).alias("cap"))
        nodes = nodes.withColumn("weight", weight_of(level, F.col(level)).cast("long"))
        up = path[:-1]
        if up:
            # the level columns are never NULL here, so a plain equi-join is exact
            nodes = nodes.join(parents.select(*up, "budget"), up)
        else:
            nodes = nodes.withColumn("budget", F.lit(budget).cast(BIG)).withColumn("_root", F.lit(0))
            up = ["_root"]
        parents = split_budget(nodes, up, level).select(*path, F.col("share").alias("budget"))
    return leaves.join(parents, list(levels))


def mix(docs: DataFrame, levels: Sequence[str], tokens: Column, key: str, fraction: tuple[int, int],
        weight_of, seed: int = 17, max_epochs: int = 1) -> DataFrame:
    """Select documents so that token shares follow the tree's weights.

    ``fraction`` (numerator, denominator) of all tokens is the budget. Level
    columns must not be NULL (map NULL to a name first). A document may be chosen
    once per epoch, up to ``max_epochs``; whole epochs take every document, the
    last, partial one takes the documents whose running token sum in that epoch's
    seeded order stays within what is left of the leaf's budget. Documents without
    tokens never count against a budget: they come with a leaf's first document
    order like any other. Rows that share a key are ordered together and cut
    together. Empty tables give an empty result; columns of ``docs`` other than
    those named are carried along.
    """
    keep = [c for c in docs.columns]
    base = materialise(docs.withColumn("_tok", F.coalesce(tokens, F.lit(0)).cast("long")), "mix-tokens")
    leaves = base.groupBy(*levels).agg(F.sum("_tok").cast(BIG).alias("supply")) \
        .withColumn("cap", (F.col("supply") * F.lit(max_epochs)).cast(BIG))
    total = base.agg(F.coalesce(F.sum("_tok"), F.lit(0)).cast(BIG).alias("t")).first()["t"]
    root = min(int(total) * max_epochs, int(total) * fraction[0] // fraction[1])
    budgets = leaf_budgets(leaves, levels, root, weight_of)
    # a leaf's budget is q whole epochs and a rest; at most one row per leaf
    plan = budgets.withColumn("_q", F.expr("case when supply > 0 then cast(budget div supply as int) else 0 end")) \
        .withColumn("_rest", F.expr("cast(budget - _q * supply as decimal(38,0))")) \
        .select(*levels, "_q", "_rest")
    plan = materialise(plan, "mix-plan")
    # The plan has one row per leaf (domain, language, source): far smaller than the
    # documents, and joined by shuffle-free broadcast only if Spark measures it small.
    joined = base.join(plan, list(levels))
    whole = joined.where("_q > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_q") - 1))) \
        .select(*keep, F.col("_tok").alias("n_tokens"), "epoch")
    part = joined.where("_rest > 0 and _q < %d" % max_epochs)
    part = part.withColumn("_h", order_hash(seed, F.col("_q"), F.col(key)))
    slim = part.select(*levels, "_h", "_tok", "_rest", "_q")
    # Running token sums in two steps, so that a leaf with a third of all rows is
    # spread over SLICES tasks: sums per slice of the hash order, then inside.
    per_hash = slim.groupBy(*levels, "_h").agg(F.sum("_tok").alias("_tok"), F.max("_rest").alias("_rest")) \
        .withColumn("_slice", F.substring("_h", 1, 2))
    slices = per_hash.groupBy(*levels, "_slice").agg(F.sum("_tok").cast(BIG).alias("_st"))
    offsets = slices.withColumn("_off", F.coalesce(F.sum("_st").over(
        Window.partitionBy(*levels).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(BIG))
    edge = offsets.join(plan, list(levels))
    # a slice lies wholly inside the budget, wholly outside, or is the one that is cut
    edge = edge.select(*levels, "_slice", "_off",
                       F.expr("case when _off + _st <= _rest then 1 when _off > _rest then 2 else 0 end").alias("_state"))
    cut = per_hash.join(edge.where("_state = 0"), [*levels, "_slice"]) \
        .withColumn("_run", F.sum("_tok").over(Window.partitionBy(*levels, "_slice").orderBy("_h")) + F.col("_off")) \
        .where("_run <= _rest").groupBy(*levels, "_slice").agg(F.max("_h").alias("_last"))
    state = materialise(edge.where("_state < 2").join(cut, [*levels, "_slice"], "left"), "mix-slices")
    chosen = part.withColumn("_slice", F.substring("_h", 1, 2)) \
        .join(state, [*levels, "_slice"]) \
        .where("_state = 1 or _h <= _last") \
        .select(*keep, F.col("_tok").alias("n_tokens"), F.col("_q").cast("int").alias("epoch"))
    return whole.select(*keep, "n_tokens", F.col("epoch").cast("int").alias("epoch")).unionByName(chosen)


# --- production parameters -----------------------------------------------------

LEVELS = ("domain", "language", "origin")
LANGUAGE_WEIGHTS = {"en": 4, "de": 3, "fr": 2, "es": 2}
N_DOMAINS = 4
SEED = 17


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo four, ``d-`` without a number."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("d-")).otherwise(
        F.concat(F.lit("d"), (digits.cast("long") % N_DOMAINS).cast("string")))


def production_weight(level: str, name: Column) -> Column:
    if level != "language":
        return F.lit(1)
    out = F.lit(1)
    for lang, w in LANGUAGE_WEIGHTS.items():
        out = F.when(name == lang, F.lit(w)).otherwise(out)
    return out


def n_tokens() -> Column:
    """White-space words of the whole text."""
    return F.size(words_of(F.col("text")))


def mix_documents(docs: DataFrame, tokens: Column, fraction: tuple[int, int] = (3, 5), seed: int = SEED,
                  max_epochs: int = 1) -> DataFrame:
    """``mix`` over the columns of ``documents``; NULL language or source is a node
    of its own (named ``-``)."""
    tree = docs.withColumns({
        "domain": domain_of(F.col("source")),
        "language": F.coalesce("lang", F.lit("-")),
        "origin": F.coalesce("source", F.lit("-"))})
    return mix(tree, LEVELS, tokens, "doc_id", fraction, production_weight, seed, max_epochs)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs at most and 110 % of the tokens, so rare sources repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", n_tokens().alias("_n"))
    out = mix_documents(docs, F.col("_n"), fraction=(11, 10), max_epochs=2)
    return out.select("doc_id", *LEVELS, "epoch", "n_tokens")


ORACLE_SQL_TEMPLATE = """
with d as (
  select {cols}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) n_tokens,
    case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'd-'
         else 'd' || (cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint) % {domains}) end domain,
    coalesce(lang, '-') "language", coalesce(source, '-') origin
  from {docs}),
leaf as (select domain, "language", origin, cast(sum(n_tokens) as hugeint) supply,
                cast(sum(n_tokens) * {epochs} as hugeint) cap from d group by all),
root as (select least(sum(cap), cast(sum(supply) as hugeint) * {num} // {den}) budget from leaf),
{levels}
plan as (select l.domain, l."language", l.origin,
                case when supply > 0 then cast(share // supply as integer) else 0 end q,
                case when supply > 0 then share - (share // supply) * supply else share end rest
         from leaf l join s3 using (domain, "language", origin)),
j as (select * from d join plan using (domain, "language", origin)),
p as (select *, md5('{seed}-' || q || '-' || coalesce(cast(doc_id as varchar), '~')) h from j
      where rest > 0 and q < {epochs}),
r as (select *, sum(n_tokens) over (partition by domain, "language", origin order by h) run from p),
chosen as (
  select * exclude (q, rest), cast(unnest(range(q)) as integer) epoch from j where q > 0
  union all
  select * exclude (q, rest, h, run), q epoch from r where run <= rest)
"""

_LEVEL_SQL = """n{i} as (select {path}, cast(sum(cap) as hugeint) cap, {weight} weight from leaf group by {path}),
b{i} as (select n{i}.*, {up_budget} budget from n{i} {up_join}),
o{i} as (select *, row_number() over w rn,
           coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0) used,
           sum(weight) over (w rows between current row and unbounded following) wsum
         from b{i} window w as ({part} order by (cap * 1000000) // weight, {level})),
f{i} as (select *, greatest(budget - used, 0) lft, cap * wsum <= greatest(budget - used, 0) * weight fits from o{i}),
t{i} as (select *, min(case when not fits then rn end) over ({part}) stop,
           min_by(lft, rn) filter (not fits) over ({part}) sl,
           min_by(wsum, rn) filter (not fits) over ({part}) sw from f{i}),
s{i} as (select {path}, cast(case when stop is null or rn < stop then cap
                             else least(cap, sl * weight // sw) end as hugeint) share from t{i}),"""


def mixing_oracle(select: str, docs: str = "documents", cols: str = "doc_id",
                  fraction: tuple[int, int] = (11, 10), seed: int = SEED, max_epochs: int = 2) -> str:
    """DuckDB twin of ``mix_documents`` followed by ``select`` over ``chosen``."""
    quoted = ['domain', '"language"', 'origin']
    parts = []
    for i, level in enumerate(quoted, 1):
        path, up = ", ".join(quoted[:i]), quoted[:i - 1]
        weight = "1" if i != 2 else "case \"language\" " + " ".join(
            f"when '{k}' then {v}" for k, v in LANGUAGE_WEIGHTS.items()) + " else 1 end"
        parts.append(_LEVEL_SQL.format(
            i=i, path=path, level=level, weight=weight,
            part=f"partition by {', '.join(up)}" if up else "",
            up_budget=f"s{i - 1}.share" if up else "(select budget from root)",
            up_join=f"join s{i - 1} using ({', '.join(up)})" if up else ""))
    return ORACLE_SQL_TEMPLATE.format(
        cols=cols, docs=docs, domains=N_DOMAINS, epochs=max_epochs, num=fraction[0], den=fraction[1],
        seed=seed, levels="\n".join(parts)) + select


OP9_ORACLE = mixing_oracle(
    'select doc_id, domain, "language", origin, epoch, cast(n_tokens as bigint) n_tokens from chosen')
