"""Operator 2: main text of web pages by nearest-URL page differencing.

Every page is cut into text lines (its blocks). Pages are ordered by path within
their host; a page's nearest neighbours by URL usually share its template. The
lines of a page are aligned with those of its neighbour by longest common
subsequence, and shared lines are deleted as template. A neighbour that is a copy of
the page (most text shared) is passed over for the other one.

Two things are decided by markup, because differencing alone gets them wrong:
elements that declare what they are (navigation, footers, forms, adverts, comments
...) go even where their text differs from page to page, and lines inside a declared
article stay even where a neighbour quotes the same passage.
So differencing decides pages without a declared article only; every page of the
intended tables declares one (counts in the README).
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.llm.common import materialise, prepare_python, table

COPY_SHARE = 0.6           # neighbours sharing more of the text are copies
MAX_BROADCAST_PAGES = 200_000

# Elements whose text is never shown or never article text.
DROPPED = frozenset("""head script style noscript template iframe object svg canvas math nav menu footer aside
form button select textarea option datalist dialog audio video map""".split())
RAW = frozenset(("script", "style", "textarea", "noscript", "template", "iframe"))
ARTICLE = frozenset(("article", "main"))
# Elements that start and end a block of text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul title head""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that name page furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|widget\w*|nav\w*|menu\w*"
    r"|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|discussion"
    r"|replies|reply|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|toolbar"
    r"|pagination|pager|skip|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
# Possessive runs: an attempt that fails costs one scan. Names end at "<" and quotes too.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>\"'<]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]+)|<", re.S)
_TAG_NAME = re.compile(r"</?[a-zA-Z][^\s/>\"'<]*+")
_CLOSERS = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_LONG_NUMBER = re.compile(r"&#([0-9]{9,})")

KEPT, PLAIN, FURNITURE = "article", "plain", "furniture"


def _declared(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the element declares itself page furniture."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ARTICLE or tag in ("body", "html"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role") and NAMES.search(value):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class _Unclosed:
    """Tells whether the tag that starts at a position ever closes (a ``>`` outside
    quotes follows). Quotes and ``>`` from which no scan closes are remembered, so all
    questions about one page cost one pass over it, however many tags stay open."""

    def __init__(self, page: str):
        self.page, self.at, self.dead = page, [m.start() for m in _CLOSERS.finditer(page)], set()
        # for each quote or ">", the index after the quote that closes it (0: none follows)
        last: dict[str, int] = {}
        self.after = [0] * len(self.at)
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            self.after[i] = last.get(c, 0)
            last[c] = i + 1

    def closes(self, start: int) -> bool:
        m = _TAG_NAME.match(self.page, start)
        if not m:
            return True
        i, seen = bisect_left(self.at, m.end()), []
        while i < len(self.at) and i not in self.dead:
            if self.page[self.at[i]] == ">":
                return True
            seen.append(i)
            i = self.after[i]
            if not i:
                break
        self.dead.update(seen)
        return False


def _decoded(text: str) -> str:
    """Character references decoded. Numbers beyond Unicode stand for U+FFFD; those of
    thousands of digits are cut to that before they are read as numbers."""
    return html_lib.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:9], text))


def text_lines(page: str | None) -> list[tuple[str, str]]:
    """(text, kind) of the blocks of a page in order: character references decoded,
    white space as single spaces, trimmed, blank blocks left out. ``kind`` is
    ``article``, ``plain`` or ``furniture``. A ``<`` whose tag never closes is text. Time
    grows with the length of the page, whatever it holds."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    # open elements: tag, furniture, article, text of the block that an inline piece of
    # furniture interrupts
    stack: list[tuple[str, bool, bool, list[str] | None]] = []
    opened: Counter = Counter()  # open elements by tag
    bad = good = 0

    def flush():
        if parts:
            line = _SPACE.sub(" ", _decoded("".join(parts))).strip()
            parts.clear()
            if line:
                out.append((line, FURNITURE if bad else KEPT if good else PLAIN))

    def close(to: int):
        nonlocal bad, good, parts
        while len(stack) > to:
            tag, b, g, held = stack[-1]
            if held is not None or tag in BLOCKS:
                flush()
            stack.pop()
            opened[tag] -= 1
            bad -= b
            good -= g
            if held is not None:  # flushed above, so nothing is lost
                parts = held

    raw = ""
    page = page or ""
    at, end = 0, len(page)
    last = page.rfind(">")
    unclosed: _Unclosed | None = None
    while at < end:
        if raw:
            m = re.compile(rf"</{raw}\s*>", re.I).search(page, at)
            at = m.start() if m else end
            raw = ""
            if at >= end:
                break
        if page[at] == "<" and not page.startswith("<!--", at) and (
                at > last or unclosed is not None and not unclosed.closes(at)):
            parts.append("<")
            at += 1
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            parts.append(m[4])
            continue
        tag = m[2]
        if tag is None:
            if m[0] == "<":
                parts.append("<")
                if unclosed is None and _TAG_NAME.match(page, at - 1):
                    unclosed = _Unclosed(page)
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCKS
        if m[1]:
            if opened[tag]:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                close(to)
            elif block:
                flush()
            continue
        if block:
            flush()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
        if tag in VOID or m[3].endswith("/"):
            continue
        b = _declared(tag, m[3], good > 0)
        # inline elements matter only when they are furniture
        if block or b:
            g = tag in ARTICLE
            stack.append((tag, b, g, None if block else parts))
            opened[tag] += 1
            if not block:
                parts = []
            bad += b
            good += g
        if tag in RAW:
            raw = tag
    close(0)
    flush()
    return out


def main_lines(lines: list[tuple[str, str]], deleted=()) -> list[str]:
    """Lines of the article if the page declares one, else the plain lines, without the
    deleted ones (indices into ``lines``)."""
    gone = set(deleted)
    if any(k == KEPT for _, k in lines):
        return [t for t, k in lines if k == KEPT]
    return [t for i, (t, k) in enumerate(lines) if k == PLAIN and i not in gone]


def common_subsequence(a: list, b: list) -> list[int]:
    """Indices of ``a`` in one longest common subsequence with ``b`` (equal ends are
    matched first, the middle by dynamic programming over two rows of bits)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    ends = [*range(lo), *range(ha, len(a))]
    x, y = a[lo:ha], b[lo:hb]
    shared = set(x) & set(y)
    xi = [i for i, v in enumerate(x) if v in shared]
    y = [v for v in y if v in shared]
    if not xi or not y:
        return sorted(ends)
    # bit-parallel rows: bit j of rows[i] is 0 where y[j] adds to the subsequence
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for i in xi:
        m = row & where[x[i]]
        row = ((row + m) | (row - m)) & full
        rows.append(row)

    def length(r: int, j: int) -> int:
        return j - ((r & ((1 << j) - 1)).bit_count())
    out, j = [], len(y)
    for i in range(len(xi) - 1, -1, -1):
        before = rows[i - 1] if i else full
        while j and length(rows[i], j - 1) == length(rows[i], j):
            j -= 1
        if not j:
            break
        if length(before, j) < length(rows[i], j):
            out.append(lo + xi[i])
            j -= 1
    return sorted(ends + out)


def shared_lines(own: list[int], sizes: list[int], neighbours: list[list[int]]) -> list[int]:
    """Indices of lines shared with the nearest neighbour that is not a copy."""
    total = sum(sizes)
    for other in neighbours:
        if not other:
            continue
        hit = common_subsequence(own, other)
        if sum(sizes[i] for i in hit) <= COPY_SHARE * total:
            return hit
    return []


def _neighbours(pages: DataFrame) -> DataFrame:
    """(rid, near, far): the rows before and after in (host, path) order on the same
    host, the one with the longer common path first. The order is cut by sampled
    ranges, so a host with a third of all pages is many tasks; the rows at the cuts
    (two per range) are linked in a second step."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = F.struct("host", "path", "rid")
    ranked = materialise(pages.select("host", "path", "rid").repartitionByRange(n, "host", "path", "rid")
                         .withColumn("pid", F.spark_partition_id()), "html-order")
    w = Window.partitionBy("pid").orderBy("host", "path", "rid")
    inside = ranked.select("*", F.lag(o).over(w).alias("p"), F.lead(o).over(w).alias("q"))
    edges = ranked.groupBy("pid").agg(F.min(o).alias("lo"), F.max(o).alias("hi"))  # one row per range
    we = Window.partitionBy(F.lit(0)).orderBy("pid")
    edges = edges.select("pid", F.lag("hi").over(we).alias("ph"), F.lead("lo").over(we).alias("nl"))
    linked = inside.join(edges, "pid").select(
        "rid", "host", "path", F.coalesce("p", "ph").alias("p"), F.coalesce("q", "nl").alias("q"))

    def common(c: str):
        k = F.least(F.length("path"), F.length(f"{c}.path"))
        # paths are short; positions where the prefixes still agree
        return F.when(F.col(f"{c}.host") == F.col("host"), F.size(F.filter(
            F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring("path", F.lit(1), i) == F.substring(F.col(f"{c}.path"), F.lit(1), i)))).otherwise(-1)
    scored = linked.select("rid", F.col("p.rid").alias("prev"), F.col("q.rid").alias("next"),
                           common("p").alias("a"), common("q").alias("b"))
    scored = scored.select("rid", F.when(F.col("a") >= 0, F.col("prev")).alias("p"),
                           F.when(F.col("b") >= 0, F.col("next")).alias("q"), "a", "b")
    return scored.select("rid", F.when(F.col("a") >= F.col("b"), F.col("p")).otherwise(F.col("q")).alias("near"),
                         F.when(F.col("a") >= F.col("b"), F.col("q")).otherwise(F.col("p")).alias("far"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text) of every row of ``pages``.

    NULL or empty html gives an empty text. A NULL url is a host of its own without a
    path. Repeated rows are separate pages (and copies of each other, so neither
    deletes the other's text). A page without a neighbour is only cleaned by markup.
    Very long and malformed pages take time in proportion to their length. Other columns
    are ignored, whatever their names.
    """
    spark = pages.sparkSession
    prepare_python(spark)
    src = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    schema = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("_id", T.LongType()), T.StructField("_url", T.StringType()),
        T.StructField("article", T.BooleanType()), T.StructField("text", T.StringType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("plain", T.ArrayType(T.IntegerType()))])

    def parse(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for h in b.column(2):
                lines = text_lines(h.as_py())
                article = any(k == KEPT for _, k in lines)
                out[0].append(rid)
                rid += 1
                out[1].append(article)
                out[2].append("\n\n".join(main_lines(lines)))
                out[3].append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines])
                out[4].append([len(t) for t, _ in lines])
                out[5].append([] if article else [i for i, (_, k) in enumerate(lines) if k == PLAIN])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), b.column(0), b.column(1), pa.array(out[1], pa.bool_()),
                 pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64())),
                 pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], pa.list_(pa.int32()))],
                names=[f.name for f in schema.fields])

    parsed = materialise(src.mapInArrow(parse, schema), "html-lines")
    address = F.coalesce("_url", F.lit(""))
    near = _neighbours(parsed.select(
        "rid", F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "").alias("path")))
    lines = parsed.select("rid", "keys")
    links = near.select("rid", F.posexplode(F.array("near", "far")).alias("o", "other")).where("other is not null")
    beside = links.join(lines.withColumnRenamed("rid", "other"), "other") \
        .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("o", "keys"))).alias("beside"))
    aligned = parsed.select("rid", "article", "keys", "sizes", "plain").join(beside, "rid")

    def align(batches):
        import pyarrow as pa
        for b in batches:
            rid, gone = [], []
            for r, keys, sizes, plain, other in zip(*(b.column(i).to_pylist() for i in range(5))):
                hit = set(shared_lines(keys, sizes, [x["keys"] for x in other]))
                # indices among the page's plain lines; an article's lines all stay
                cut = [n for n, i in enumerate(plain) if i in hit]
                if cut:
                    rid.append(r)
                    gone.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                                             names=["rid", "gone"])

    cuts = materialise(aligned.select("rid", "keys", "sizes", "plain", "beside")
                       .mapInArrow(align, "rid long, gone array<int>"), "html-shared")
    if cuts.count() <= MAX_BROADCAST_PAGES:
        cuts = F.broadcast(cuts)
    blocks = F.split("text", "\n\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(blocks) - 1), F.col("gone")),
                                    lambda i: F.get(blocks, i)), "\n\n")
    return parsed.join(cuts, "rid", "left").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
