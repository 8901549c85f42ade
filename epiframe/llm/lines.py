"""Operator 6: line dedup by a deletion-neighbourhood join.

Two lines are near copies when their edit distance is at most ``max_edits`` (0 or
1). An occurrence of a line is removed when an earlier occurrence (by document id,
then a digest of the whole text, then line number) is equal or a near copy.

1. Equal lines are one group: a pre-aggregated minimum of the occurrence order.
2. A distinct line can only have a near copy if half of it, at the same length,
   occurs in another line (one edit leaves one half alone). Lines whose halves are
   all unique leave here; this drops no pair.
3. The rest emit every variant with at most one character deleted as a hashed key
   (two polynomial prefix sums, linear in the length of the line). Lines that
   share a variant are at most one edit apart when the deletion is at the same
   place (substitution) or when one of them is the variant itself (insertion), so
   the earliest partner of a line is a minimum per key, not a list of pairs.
4. The partner is fetched and its edit distance verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import SPACE_CHARS, materialise, prepare_python, table

# Distinct candidate lines up to this many are sent to all tasks as two 64-bit
# hashes (at most 8 MB); beyond it they are joined by a shuffle.
MAX_BROADCAST_LINES = 500_000
NO_ID = (1 << 63) - 1  # a NULL document id comes last
P1, P2 = (1 << 31) - 1, (1 << 31) - 19
B1, B2 = 1_000_003, 92_821_753


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACE_CHARS)) != ""


def text_digest(text: Column) -> Column:
    """First 60 bits of the text's MD5, so rows that share an id stay apart."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def row_key(id_col: str, text: str) -> list[Column]:
    """(d, t): document id (NULL last) and text digest of a row."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), text_digest(F.col(text)).alias("t")]


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, l, line) of every line with a word; line numbers count all lines from 0."""
    return docs.select(*row_key(id_col, text), F.posexplode(F.split(F.col(text), "\n")).alias("l", "line")) \
        .where(has_word(F.col("line")))


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves of ``line``, as the shorter of a pair (length n) and as the
    longer one (the pair's shorter length is n - 1)."""
    h, g = (n / 2).cast("int"), ((n - 1) / 2).cast("int")
    return F.array(
        F.xxhash64(n, F.lit(0), F.substring(line, F.lit(1), h)),
        F.xxhash64(n, F.lit(1), F.substring(line, h + 1, n)),
        F.xxhash64(n - 1, F.lit(0), F.substring(line, F.lit(1), g)),
        F.xxhash64(n - 1, F.lit(1), F.substring(line, g + 2, n)))


def variant_keys(lines: DataFrame) -> DataFrame:
    """(d, t, l, line) -> (d, t, l, v, n, p): hash and length of the line itself (p = -1) and
    of each one-character deletion at p."""
    prepare_python(lines.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        # powers and their inverses grow with the longest line seen
        powers: dict[int, list] = {}

        def power(b: int, p: int, n: int):
            have = powers.get(b)
            if have is None or len(have) < n:
                size = max(1024, 1 << (n - 1).bit_length())
                out = np.ones(size, np.uint64)
                k = 1
                while k < size:  # doubling: b^(k+i) = b^k * b^i
                    out[k:2 * k] = out[:k] * np.uint64(pow(b, k, p)) % np.uint64(p)
                    k *= 2
                powers[b] = have = out
            return have[:n]

        def hashes(c, b: int, p: int):
            """Hash of the whole and of every deletion: sum of c[i] * b^i mod p."""
            m = np.uint64(p)
            pw = power(b, p, len(c))
            s = np.concatenate([[np.uint64(0)], np.cumsum(c * pw % m, dtype=np.uint64) % m])
            inv = np.uint64(pow(b, -1, p))
            after = (s[-1] + m - s[1:]) % m
            return s[-1], (s[:-1] + after * inv) % m

        for batch in batches:
            for d, t, l, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
                n = len(c)
                w1, d1 = hashes(c, B1, P1)
                w2, d2 = hashes(c, B2, P2)
                v = np.concatenate([[w1 << np.uint64(32) | w2], d1 << np.uint64(32) | d2]).view(np.int64)
                size = np.full(n + 1, n - 1, np.int32)
                size[0] = n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + 1, d, np.int64)), pa.array(np.full(n + 1, t, np.int64)),
                     pa.array(np.full(n + 1, l, np.int32)), pa.array(v), pa.array(size),
                     pa.array(np.arange(-1, n, dtype=np.int32))], names=["d", "t", "l", "v", "n", "p"])

    return lines.select("d", "t", "l", "line").mapInArrow(run, "d long, t long, l int, v long, n int, p int")


def removed_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = 10, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(d, t, l) of every line occurrence to remove (:func:`row_key`, line number).

    Lines without a word are never removed. Lines under ``min_chars`` code points are
    only compared for equality (one edit would change what they say). NULL texts have
    no lines. Rows that share an id are told apart by their texts, and so are rows
    without an id, which come last; rows equal in both are one document and treated
    alike, so no line is lost with all its copies.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    occ = line_occurrences(docs, id_col, text)
    n = F.char_length("line")
    keyed = occ.select("d", "t", "l", *_identity(F.col("line")),
                       F.when(n >= min_chars, half_keys(F.col("line"), n)).alias("k"))
    distinct = keyed.groupBy("h1", "h2").agg(
        F.min(F.struct("d", "t", "l")).alias("o"), F.count("*").alias("c"), F.first("k").alias("k"))
    distinct = materialise(distinct, "lines-distinct")
    if max_edits:
        # Only (line hash, key) pairs are shuffled; two lines whose 64-bit hashes agree are
        # told apart again below, where both hashes are joined.
        halves = distinct.where("k is not null").select("h1", F.explode("k").alias("k"))
        shared = halves.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
        hit = materialise(halves.join(shared, "k", "left_semi").select("h1").distinct(), "lines-hits")
        near = materialise(_with_small(distinct.select("h1", "h2", "o", "c"), hit, "h1"), "lines-candidates")
        later = materialise(_near_copies(occ, near), "lines-later")
        # lines to drop whole, and repeated lines that keep their first occurrence
        gone = near.join(later, ["h1", "h2"]).select("h1", "h2", "o", F.lit(True).alias("gone")).unionByName(
            distinct.where("c > 1").join(later, ["h1", "h2"], "left_anti").select("h1", "h2", "o", F.lit(False).alias("gone")))
    else:
        gone = distinct.where("c > 1").select("h1", "h2", "o", F.lit(False).alias("gone"))
    out = keyed.select("d", "t", "l", "h1", "h2").join(gone, ["h1", "h2"]) \
        .where(F.col("gone") | (F.struct("d", "t", "l") != F.col("o")))
    return out.select("d", "t", "l")


def _with_small(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``; broadcast only when counted small."""
    keys = keys.select(*on)
    return df.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST_LINES else keys, list(on), "left_semi")


def _near_copies(occ: DataFrame, near: DataFrame) -> DataFrame:
    """(h1, h2) of candidate lines with an earlier near copy."""
    texts = _with_small(occ.select("d", "t", "l", "line", *_identity(F.col("line"))), near, "h1", "h2")
    # one row per distinct line: its first occurrence
    first = near.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), "o.d", "o.t", "o.l")
    texts = texts.join(first, ["d", "t", "l"]).where("h1 = a1 and h2 = a2").select("h1", "h2", "d", "t", "l", "line") \
        .dropDuplicates(["h1", "h2"])
    texts = materialise(texts, "lines-texts")
    keys = materialise(variant_keys(texts), "lines-variants").withColumn("o", F.struct("d", "t", "l"))
    dels, own = keys.where("p >= 0"), keys.where("p < 0").select("v", "n", "o")
    # earliest line with the same deletion at the same place
    subs = dels.join(dels.groupBy("v", "n", "p").agg(F.min("o").alias("e"), F.count("*").alias("c"))
                     .where("c > 1").select("v", "n", "p", "e"), ["v", "n", "p"]).where("e < o").select("o", "e")
    # the variant itself is a line: either may be the earlier one
    with_own = dels.join(own.withColumnRenamed("o", "e"), ["v", "n"])
    ins = with_own.where("e < o").select("o", "e")
    outs = with_own.groupBy("v", "n", "e").agg(F.min("o").alias("m")).where("m < e") \
        .select(F.col("e").alias("o"), F.col("m").alias("e"))
    pairs = subs.unionByName(ins).unionByName(outs).distinct()
    left = texts.select(F.struct("d", "t", "l").alias("o"), "h1", "h2", "line")
    right = texts.select(F.struct("d", "t", "l").alias("e"), F.col("line").alias("other"))
    return pairs.join(left, "o").join(right, "e") \
        .where((F.abs(F.char_length("line") - F.char_length("other")) <= 1) &
               (F.levenshtein("line", "other", 1).between(0, 1))).select("h1", "h2").distinct()


def cut_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = 10, id_col: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): the columns of ``docs`` but the text as one
    struct, the text without its removed lines, lines with a word, and removed ones. The
    text travels once, and no column of ``docs`` can clash."""
    # rows equal in id and text name their lines once each
    gone = removed_lines(docs, max_edits, min_chars, id_col, text) \
        .groupBy("d", "t").agg(F.collect_set("l").alias("gone"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    base = docs.select(*row_key(id_col, text), F.col(text).alias("text"), F.struct(*rest).alias("row"))
    out = base.join(gone, ["d", "t"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")),
                    lambda i: F.get("lines", i)), "\n"))
    return out.select(
        "row", kept.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("lines", has_word))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = 10, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``, plus ``n_lines`` (lines with
    a word) and ``n_removed`` (either replaces a column of its name). Other columns are
    carried; a NULL text stays NULL; an empty table stays empty; texts of any length and
    repeated rows are handled as in :func:`removed_lines`."""
    cut = cut_lines(docs, max_edits, min_chars, id_col, text)
    new = (text, "n_lines", "n_removed")
    return cut.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new],
                      F.col("text").alias(text), "n_lines", "n_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_sql(docs: str = "documents", min_chars: int = 10) -> str:
    """CTEs of the DuckDB twin ending in ``deduped`` (doc_id, text, n_lines, n_removed)."""
    return f"""
kd as (select *, coalesce(doc_id, {NO_ID}) d, ('0x' || md5(coalesce(text, ''))[1:15])::bigint t from {docs}),
occ as (select d, t, l, line from (
          select d, t, unnest(string_split(text, chr(10))) line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 l from (select distinct d, t, text from kd))
        where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl as (select line, min(struct_pack(d := d, t := t, l := l)) o, length(line) n from occ group by line),
cand as (select a.line, a.o from dl a join dl b on a.n = b.n and left(a.line, a.n // 2) = left(b.line, a.n // 2)
           where b.o < a.o and a.n >= {min_chars} and levenshtein(a.line, b.line) = 1
         union all
         select a.line, a.o from dl a join dl b on a.n = b.n and substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2 + 1)
           where b.o < a.o and a.n >= {min_chars} and levenshtein(a.line, b.line) = 1
         union all
         select case when s.o < t.o then t.line else s.line end, greatest(s.o, t.o)
           from dl s join dl t on t.n = s.n + 1 and left(s.line, s.n // 2) = left(t.line, s.n // 2)
           where s.n >= {min_chars} and levenshtein(s.line, t.line) = 1
         union all
         select case when s.o < t.o then t.line else s.line end, greatest(s.o, t.o)
           from dl s join dl t on t.n = s.n + 1 and substr(s.line, s.n // 2 + 1) = substr(t.line, s.n // 2 + 2)
           where s.n >= {min_chars} and levenshtein(s.line, t.line) = 1),
gone as (select d, t, occ.l from occ join dl using (line)
         where struct_pack(d := d, t := t, l := occ.l) <> o or line in (select line from cand)),
per as (select d, t, list(l) g from gone group by all),
deduped as (
  select kd.* exclude (d, t) replace (
      case when g is null then text else
        array_to_string(list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: not list_contains(g, i)),
                                       lambda i: string_split(text, chr(10))[i + 1]), chr(10)) end as text),
    case when text is null then 0 else len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) end n_lines,
    coalesce(len(g), 0) n_removed
  from kd left join per using (d, t))"""


OP6_ORACLE = f"""with {line_dedup_sql()}
select doc_id, cast(n_lines as bigint) n_lines, cast(n_removed as bigint) n_removed,
       sha256(coalesce(text, '')) kept_sha256 from deduped"""
