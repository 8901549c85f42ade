"""Operators of the training-data subpackage on small tables: brute force, round trips,
NULLs, empty tables, repeated rows and clashing column names."""

import gzip
import hashlib
import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from epiframe.llm import ann, htmltext, langid, lines, mixing, neardup, pieces, quality, repeats, warc
from epiframe.session import local_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOC)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
                    + str(rng.randint(0, 999)) for _ in range(n))


# --- 1 -------------------------------------------------------------------------

def test_langid_gradients_match_finite_differences():
    import numpy as np
    net = langid.BiGru(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    batch, y = [b"abc", b"hello", b"x"], np.array([0, 2, 1])
    _, grads = net.gradients(batch, y)
    rng = np.random.default_rng(0)
    for k, w in net.w.items():
        i = tuple(rng.integers(0, s) for s in w.shape)
        if k[0] == "x":
            i = (ord("l"), i[1])
        e = 1e-3
        w[i] += e
        up = net.gradients(batch, y)[0]
        w[i] -= 2 * e
        down = net.gradients(batch, y)[0]
        w[i] += e
        assert abs((up - down) / (2 * e) - grads[k][i]) < 1e-4


def test_langid_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(langid.training_sample(docs), steps=300)
    out = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id") \
        .where(langid.held_out(F.col("doc_id"))).where("lang_pred <> 'und'")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "12 34 !!", 9), (4, "the " * 50_000, 9)],
                                "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in langid.identify(odd, net).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[None]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[4]["lang_pred"] in net.langs and 0 <= got[4]["score"] <= 1
    assert langid.identify(odd.limit(0), net).count() == 0
    assert langid.train({}) is None
    assert langid.identify(odd, None).where("lang_pred = 'und'").count() == 4


def test_langid_learns_from_long_texts_and_cuts_between_characters(spark):
    rng = random.Random(8)
    words = {"aa": ["kala", "meri", "talo", "vesi"], "bb": ["\u0434\u043e\u043c", "\u0440\u0435\u043a\u0430", "\u043b\u0435\u0441"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30_000 if k == "bb" else 40)), k)
            for i, k in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"lang_pred": F.lit("clash"), "score": F.lit(7)})
    sample = langid.training_sample(docs)
    assert set(sample) == {"aa", "bb"} and all(len(t.split()) <= langid.DOC_WORDS for ts in sample.values() for t in ts)
    net = langid.train(sample, steps=80)
    got = langid.identify(docs, net)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {i: k for i, _, k in rows}
    for w in ("\u0434" * 40, "a" + "\u4e2d" * 33, "x" * 61, "\U0001f600" * 9 + "b"):
        parts = langid.pieces_of(w)
        assert "".join(p.decode() for p in parts) == w and all(0 < len(p) <= langid.PIECE for p in parts)


def test_langid_pooled_words_equal_a_direct_run():
    import numpy as np
    net = langid.train({"a": ["one two three four"], "b": ["uno dos tres \u00e1rbol"]}, steps=5)
    texts = ["one tres \u00e1rbol one 12", "", None, "12 !", "two " * 50 + "z" * 70]
    pred, score = langid._predict(net, texts)
    again = langid._predict(net, texts[::-1])  # words remembered, other order
    assert pred == again[0][::-1] and np.allclose(score, again[1][::-1])
    for t, k, s in zip(texts, pred, score):
        cut = [p for w in (t or "").split() if any(c.isalpha() for c in w) for p in langid.pieces_of(w)]
        if not cut:
            assert (k, s) == ("und", 0.0)
            continue
        p = sum(net.position_sums([c])[0].astype(float) for c in cut) / sum(map(len, cut))
        assert k == net.langs[int(p.argmax())] and abs(s - p.max()) < 1e-5


# --- 2 -------------------------------------------------------------------------

@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\"", "<!", "</p ", "<b<", "<div>", "<div></b>", "x<span class=ad></span>",
                                  "<!--", "<p>", "&#1", "<a b='", "<script>", "</script ", '<i class="ad">'])
def test_html_time_grows_with_length(unit):
    page = unit * (300_000 // len(unit))
    for tail in ("", ">", "\">x", "'>y"):
        t0 = time.perf_counter()
        htmltext.text_lines(page + tail)
        assert time.perf_counter() - t0 < 5


def test_html_unclosed_tags_are_text():
    lines = lambda page: [t for t, _ in htmltext.text_lines(page)]
    assert lines("a <b c") == ["a <b c"]
    assert lines("<p>1 <2 and <x 'y <p>z</p>") == ["1 <2 and <x 'y", "z"]
    assert lines('<p>q <a "b</p><p title="c>d">e</p>') == ['q d">e']  # quotes pair up as they come
    assert lines("<p>a <!-- b > c") == ["a"]
    assert lines("<p>" + "&#" + "1" * 6000 + ";b &#0000000000065;</p>") == ["\ufffdb A"]


def test_html_blocks_and_declared_furniture():
    page = ('<div>a &lt;b&gt; <b>c</b>d<p class="cookie-notice">x</p>y</div><header>H</header><main><header>T</header>'
            '<p>q<span class="ad">zz</span> r</main><aside>s</aside><form><input>u</form><ul class="comments"><li>w</ul>'
            "<script>var t='</p>';</script>")
    assert htmltext.main_lines(htmltext.text_lines(page)) == ["T", "q r"]
    assert htmltext.main_lines(htmltext.text_lines("<p>one\n two<br>three<p>four &amp; five")) == ["one two three", "four & five"]
    assert htmltext.text_lines(None) == htmltext.text_lines("") == []


def test_common_subsequence_is_longest():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = htmltext.common_subsequence(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in got)


def test_page_differencing_deletes_shared_lines_only(spark):
    body = lambda t: f"<div>Site name</div><div>Menu words</div><p>{t}</p><div>Contact us</div>"
    rows = [(i, f"http://h.example/a/{i}", body(f"Story number {i} tells of {i * 7} things. " * 9)) for i in range(6)]
    rows += [(10, "http://copy.example/a", body("Same text here. " * 20)), (11, "http://copy.example/b", body("Same text here. " * 20)),
             (20, None, None), (21, "http://alone.example/", "<article><p>Lone</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in htmltext.extract_main_text(pages).collect()}
    for i in range(6):
        assert got[i] == (f"Story number {i} tells of {i * 7} things. " * 9).strip()
    assert "Same text here." in got[10] and "Same text here." in got[11]
    assert got[20] == "" and got[21] == "Lone"
    assert htmltext.extract_main_text(pages.limit(0)).count() == 0


# --- 3 -------------------------------------------------------------------------

def test_pieces_equal_the_library():
    import sentencepiece
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        model = f.read()
    fst, lib = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\té😀▁thing梦x　\xa0Z9.,") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["", "x" * 3000, "http://a.b/c?d=e", "ÀÉÎõü straße " * 40]
    for t in texts:
        assert fst.encode(t) == lib.encode(t)
        assert fst.decode(fst.encode(t)) == lib.decode(lib.encode(t))


def test_piece_operators_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "two words", 0), (None, "two words", 0)],
                               "doc_id long, text string, ids int")
    enc = pieces.encode_pieces(df)
    assert enc.where("size(ids) = 0").count() == 2 and enc.count() == 4
    assert [r["text"] for r in pieces.decode_pieces(enc).orderBy("text").collect()] == ["", "", "two words", "two words"]
    assert pieces.piece_report(df).where("round_trip").count() == 4
    assert pieces.encode_pieces(df.limit(0)).count() == 0


# --- 4 -------------------------------------------------------------------------

def test_nearest_neighbours_recall_ties_and_odd_vectors(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(5)]  # copies of a query's vector
    rows += [(3000, None), (3100, [0.0] * 24), (3200, [float("nan")] * 24), (3300, [None] * 24), (None, rows[3][1]), (3400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [(i, np.array(v)) for i, v in rows if i is not None and i < 2100]
    hit = total = 0
    for q, found in got.items():
        qv = dict(ok)[q]
        best = sorted((float(np.sqrt(((v - qv) ** 2).sum())), i) for i, v in ok if i != q)[:10]
        hit += len({i for _, i in best} & {i for i, _ in found})
        total += 10
        assert all(abs(s - float(np.sqrt(((dict(ok)[i] - qv) ** 2).sum()))) < 1e-9 for i, s in found)
    assert hit / total >= 0.9 and len(got) == 16  # 0..1400 and the copy with id 2000
    assert [i for i, _ in got[100][:5]] == [2000, 2001, 2002, 2003, 2004]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_outliers_beside_a_hot_cluster_get_all_neighbours(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(i, [1000.0] + [0.0] * 15) for i in range(100, 1600)]  # copies
    rows += [(i, rng.standard_normal(16).tolist()) for i in range(60)]
    rows += [(7, rng.standard_normal(16).tolist()) for _ in range(12)]  # an id of many rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") < 60).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 60 and all(len(found) == 10 for found in got.values())
    hit, total = 0, 0
    for q in set(got) - {7}:
        v = np.array(dict((i, x) for i, x in rows if i == q)[q])
        best = sorted((float(((np.array(x) - v) ** 2).sum()), i) for i, x in rows if i != q)[:10]
        hit += len(Counter(i for _, i in best) & Counter(got[q]))
        total += 10
    assert hit / total >= 0.9
    few = spark.createDataFrame(rows[1500:1506], df.schema)
    assert ann.nearest_neighbours(few, F.col("vec_id") == 3).count() == 5


# --- 5 -------------------------------------------------------------------------

def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows, base = [], [words(rng, 120) for _ in range(12)]
    for i, b in enumerate(base):
        rows.append((i * 100, b))
        for k in range(1, 9):  # chains: each copy edits the one before
            w = b.split()
            w[rng.randrange(len(w))] = f"edit{i}x{k}"
            b = " ".join(w)
            rows.append((i * 100 + k, b))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one  two"), (5004, "one two"), (None, base[0])]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, rows)).where("doc_id is not null").collect()}
    idf = neardup.Idf([], [])
    vec = {i: idf.vector(neardup.word_hashes(t or "")) for i, t in rows if i is not None}
    parent = {i: i for i in vec}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(vec)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(vec[i][0]) and neardup.weighted_jaccard(*vec[i], *vec[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = {i: root(i) for i in ids}
    wrong = [i for i in ids if want[i] != got[i]]
    assert not wrong
    assert neardup.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_shared_passage_is_counted_in_every_document(spark):
    import numpy as np
    rng = random.Random(9)
    passage = words(rng, 150)
    rows = [(i, passage + " " + words(rng, 10)) for i in range(200)]
    n_held = Counter(s for _, t in rows for s in set(neardup.shingles(neardup.word_hashes(t)).tolist()))
    common = np.array(sorted(s for s, n in n_held.items() if n == 200), np.uint64)
    idf = neardup.document_frequencies(docs_of(spark, rows).select("text"), 200)
    assert set((common >> np.uint64(64 - neardup.SKETCH_BITS)).tolist()) <= set(idf.frequent.tolist())
    assert np.allclose(idf.weights, np.log(2) / np.log1p(200 / neardup.RARE_LEAST), rtol=0.01)
    # equal but for the passage that all hold: 0.84 unweighted, 0.65 weighted
    vec = [idf.vector(neardup.word_hashes(t)) for _, t in rows]
    assert max(neardup.weighted_jaccard(*vec[i], *vec[j]) for i in range(200) for j in range(i)) < 0.8
    got = neardup.near_duplicates(docs_of(spark, rows)).collect()
    assert all(r["class_id"] == r["doc_id"] and r["kept"] for r in got)


@pytest.mark.parametrize("background", [0, 5, 500])
def test_idf_follows_the_share_of_documents_whatever_the_length_of_texts(monkeypatch, background):
    # counters filled by the other shingles of longer and longer texts
    import numpy as np
    n_docs, holders = 100_000, {17: 5_000, 400_000: 40_000, 900_000: 60}
    total = np.random.default_rng(3).poisson(background, 1 << neardup.SKETCH_BITS).astype(np.int64)
    for at, n in holders.items():
        total[at] += n
    monkeypatch.setattr(neardup, "shingle_counters", lambda texts: total)
    idf = neardup.document_frequencies(None, n_docs)
    weights = dict(zip(idf.frequent.tolist(), idf.weights))
    for at in (17, 400_000):
        assert weights[at] == pytest.approx(np.log1p(n_docs / holders[at]) / np.log1p(neardup.RARE_SHARE), rel=0.02)
    others = [w for at, w in weights.items() if at not in holders]
    assert len(others) <= 100 and min([1.0, *others]) > 0.95


# --- 6 -------------------------------------------------------------------------

def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:] or a == b


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(9, 16))).strip() + "x" for _ in range(40)]
    for p in list(pool):
        i = rng.randrange(len(p))
        pool += [p[:i] + "Z" + p[i + 1:], p[:i] + p[i + 1:], p[:i] + "Q" + p[i:]]
    rows = [(d, "\n".join(rng.choice(pool + ["", "  ", "ab", "ac"]) for _ in range(12))) for d in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 30_000), (103, "a" * 29_999 + "b")]
    seen, want = [], {}
    for d, t in rows:
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            if not line.strip(" \t\n\x0b\f\r"):
                continue
            if any(line == s or (min(len(line), len(s)) >= 10 and within_one_edit(line, s)) for s in seen):
                gone.append(n)
            seen.append(line)
        want[d] = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    df = docs_of(spark, rows).withColumn("l", F.lit("clash"))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == want
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_rows_that_share_or_lack_an_id(spark):
    import duckdb
    rng = random.Random(14)
    pool = [f"{w} line number {i} of the pool" for i in range(14) for w in ("first", "firsd", "other")]
    rows = [(rng.choice([7, 7, 8, None, None, 9]), "\n".join(rng.sample(pool, rng.randint(1, 6)))) for _ in range(40)]
    rows += [(None, "first shared line here\nunique line of row one"), (None, "another unique line here\nfirst shared line here"),
             (7, "x same id first one\nand a clean one"), (7, "y same id\nx same id first one"), (7, None), (None, ""), rows[0], rows[0]]

    def order(r):
        text = r[1] or ""
        return (r[0] if r[0] is not None else lines.NO_ID, int(hashlib.md5(text.encode()).hexdigest()[:15], 16))
    seen, want = [], {}
    for key in sorted({(order(r), r) for r in rows}, key=lambda k: k[0]):
        d, t = key[1]
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            if line and any(line == s or within_one_edit(line, s) for s in seen):
                gone.append(n)
            if line:
                seen.append(line)
        want[d, t] = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("d", "t", "gone", "row", "lines")})
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(df).collect()]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(got, key=key) == sorted(((d, want[d, t]) for d, t in rows), key=key)
    kept = {x for _, t in got for x in (t or "").split("\n")}
    assert {"unique line of row one", "another unique line here", "and a clean one"} <= kept
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    twin = con.execute(f"with {lines.line_dedup_sql()} select doc_id, text from deduped").fetchall()
    assert sorted(twin, key=key) == sorted(got, key=key)
    con.close()


# --- 7 -------------------------------------------------------------------------

def test_quality_statistics_against_python(spark):
    import re
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("ab c# d$ e\n f\n".split(" ")) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "\n \t\n"), (503, "a b c d e " * 4000)]
    got = {r["doc_id"]: r for r in quality.with_statistics(docs_of(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        c = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if c[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        ls = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(ls) - len(set(ls)), len(again))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_decision_list_keeps_clean_and_rejects_bad(spark):
    out = quality.op7_quality_rules(spark, "/root/testdata/sf0.01")
    judged = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() <= 0.1 * judged.where("quality = 0").count()
    empty = quality.quality_rules(docs_of(spark, [(1, words(random.Random(1), 30))]),
                                  spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.first()["kept"] is True


# --- 8 -------------------------------------------------------------------------

def test_warc_round_trip_and_salvage(spark, scratch):
    big = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (None, "u", None),
            (6, "u", "x WARC/1.1\r\n y"), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for compress in (False, True):
        path = scratch("warc-test")
        warc.write_warc(pages, path, compress=compress, records_per_file=100)
        got = sorted((warc.read_warc(spark, path).select(
            warc.page_of(F.col("record_id")).alias("p"), "record_type", "payload_bytes", "payload", "status").collect()),
            key=lambda r: (r["p"] or 0, r["record_type"]))
        assert [r["status"] for r in got] == ["ok"] * 7
        assert [(r["p"], r["record_type"]) for r in got] == [
            (None, "response"), (1, "revisit"), (2, "response"), (2, "response"), (3, "response"), (4, "response"), (6, "response")]
        assert bytes(got[2]["payload"]).decode() == big and got[1]["payload_bytes"] == len(big.encode())
    raw = b"".join(open(os.path.join(local_path(scratch_dir), f), "rb").read()
                   for scratch_dir in [_plain(spark, pages, scratch)] for f in sorted(os.listdir(local_path(scratch_dir)))
                   if f.startswith("part"))
    whole = [r for r in warc.read_archive(raw)]
    cut = whole[2]["start"] + 40
    damaged = raw[:cut] + b"garbage" + raw[cut + 3:]
    back = list(warc.read_archive(damaged))
    assert [r["status"] == "ok" for r in back].count(True) == 6
    gap = next(r for r in back if r["status"] != "ok")
    assert gap["start"] == whole[2]["start"] and gap["end"] == whole[2]["end"] + 4
    members = b"".join(gzip.compress(raw[r["start"]:r["end"]]) for r in whole)
    assert [r["status"] for r in warc.read_archive(members)] == ["ok"] * 7
    second = members.find(b"\x1f\x8b\x08", 10)
    bad = bytearray(members)
    bad[second + 30] ^= 0xFF
    got = list(warc.read_archive(bytes(bad)))
    assert sum(r["status"] == "ok" for r in got) >= 6 and any(r["status"] != "ok" for r in got)
    assert list(warc.read_archive(b"")) == []


def test_warc_damage_to_own_compressed_archives(spark, scratch):
    rng = random.Random(11)
    rows = [(i, f"http://h/{i}", f"<p>{words(rng, 12)}</p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch("warc-damaged")
    warc.write_warc(pages, path)
    folder = local_path(path)
    raw = b"".join(open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.startswith("part"))
    whole = list(warc.read_archive(raw))
    assert [r["status"] for r in whole] == ["ok"] * 300 and len({r["start"] for r in whole}) == 300
    assert len(gzip.decompress(raw).split(b"WARC/1.1\r\n")) == 301
    at, end = whole[200]["start"], whole[200]["end"]
    # a byte inside a member, its check sum, its first byte
    for spot in (at + 60, end - 8, at):
        bad = bytearray(raw)
        bad[spot] ^= 0xFF
        back = list(warc.read_archive(bytes(bad)))
        ids = {r["record_id"] for r in back if r["status"] == "ok"}
        assert {r["record_id"] for i, r in enumerate(whole) if i != 200} <= ids
        gaps = [r for r in back if r["status"] != "ok"]
        assert gaps and gaps[0]["start"] >= at and gaps[-1]["end"] == end
    # many records in a member: those before the damage are kept, the gap starts after them
    plain = gzip.decompress(raw)
    for many in (gzip.compress(plain), gzip.compress(plain)[:-40]):
        bad = bytearray(many)
        bad[len(many) - 30] ^= 0xFF
        back = list(warc.read_archive(bytes(bad)))
        assert sum(r["status"] == "ok" for r in back) >= 290
        assert back[-1]["status"].startswith("quarantined") and back[-1]["end"] == len(bad)
        assert len(bad) - 1000 < back[-1]["start"] < len(bad)
    # 16 MB or more: an empty member supplies the zero byte
    big = b"x" * (1 << 24)
    assert gzip.decompress(warc.gzip_member(big) + b"\0") == big


@pytest.mark.parametrize("compress", [False, True])
def test_archives_are_bounded_by_bytes(spark, scratch, compress):
    rng = random.Random(5)
    sizes = [10, 400_000, 20, 30, 250_000, 250_000, 5, 900_000, 1]
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefghij", k=n)), "x", i, "y") for i, n in enumerate(sizes)]
    # columns that the operator makes, under their own names
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, _id int, value string").coalesce(1)
    path = scratch("warc-bytes")
    limit = 300_000
    warc.write_warc(pages, path, compress=compress, bytes_per_file=limit)
    folder = local_path(path)
    files = [os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.startswith("part")]
    assert len(files) > 2 and max(files) < limit + 900_000 + 1000
    back = warc.read_warc(spark, path)
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in back.collect()}
    assert got == {f"<urn:page:{r[0]}>": r[2] for r in rows}
    assert back.where("status <> 'ok'").count() == 0
    nothing = scratch("warc-empty")
    warc.write_warc(pages.limit(0), nothing, compress=compress)
    assert warc.read_warc(spark, nothing).count() == 0


def _plain(spark, pages, scratch):
    path = scratch("warc-plain")
    warc.write_warc(pages, path, compress=False, records_per_file=100)
    return path


# --- 9 -------------------------------------------------------------------------

def test_budget_goes_to_siblings_before_ancestors(spark):
    # a.x holds little: its shortage goes to a.y, not to b
    leaves = spark.createDataFrame([("a", "x", 10, 10), ("a", "y", 1000, 1000), ("b", "z", 1000, 1000)],
                                   "p string, q string, supply long, cap long") \
        .withColumn("supply", F.col("supply").cast("decimal(38,0)")).withColumn("cap", F.col("cap").cast("decimal(38,0)"))
    got = {(r["p"], r["q"]): int(r["budget"]) for r in
           mixing.leaf_budgets(leaves, ["p", "q"], 400, lambda level, c: F.lit(1)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    got = {(r["p"], r["q"]): int(r["budget"]) for r in
           mixing.leaf_budgets(leaves, ["p", "q"], 2010, lambda level, c: F.lit(1)).collect()}
    assert sum(got.values()) == 2010


def test_mix_prefix_epochs_and_odd_rows(spark):
    rows = [(i, words(random.Random(i), 5 + i % 7), None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", 0)
            for i in range(200)] + [(900, None, "de", "x", 0), (901, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("epoch_", F.lit(1))
    once = mixing.mix_documents(docs, mixing.n_tokens(), (1, 2))
    total = docs.select(F.sum(mixing.n_tokens())).first()[0]
    taken = once.agg(F.sum("n_tokens")).first()[0]
    assert once.count() == once.select("doc_id").distinct().count() and 0.3 * total < taken <= 0.5 * total
    again = mixing.mix_documents(docs.repartition(7), mixing.n_tokens(), (1, 2))
    assert {r[0] for r in once.select("doc_id").collect()} == {r[0] for r in again.select("doc_id").collect()}
    twice = mixing.mix_documents(docs, mixing.n_tokens(), (2, 1), max_epochs=2)
    assert twice.agg(F.sum("n_tokens")).first()[0] == 2 * total
    assert mixing.mix_documents(docs.limit(0), mixing.n_tokens()).count() == 0


# --- 10 ------------------------------------------------------------------------

@pytest.mark.parametrize("bucket", [repeats.BUCKET, 2])
def test_repeats_against_every_window(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rng = random.Random(8)
    passage = words(rng, 90)
    half = words(rng, 40)[:390]
    rows = [(i, words(rng, 60) + passage[rng.randint(0, 40):len(passage) - rng.randint(0, 60)] + words(rng, 30)) for i in range(25)]
    rows += [(30 + i, words(rng, 20) + half + words(rng, 20)) for i in range(6)]
    rows += [(50, "a" * 1500), (51, None), (52, ""), (53, "short"), (54, rows[0][1]), (54, rows[0][1]), (55, "é" * 399 + words(rng, 80))]
    rows += [(56, passage + " mid " + passage), (None, passage), (57, "ab" * 450)]
    want = repeats.repeated_spans_by_force([(t or "").encode() for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("t", F.lit(2))
    got = sorted((r["doc_id"] or -1, [(s["s"], s["e"]) for s in r["spans"]], hashlib.sha256(r["kept"]).hexdigest())
                 for r in repeats.remove_repeats(df).collect())

    def kept(t, spans):
        b, at, out = (t or "").encode(), 0, b""
        for s, e in spans:
            out, at = out + b[at:s], e
        return hashlib.sha256(out + b[at:]).hexdigest()
    assert got == sorted((i or -1, list(s), kept(t, s)) for (i, t), s in zip(rows, want))
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_lists_of_wanted_suffixes_are_joined_by_a_shuffle(spark):
    rng = random.Random(12)
    rows = [(i, 0, words(rng, 200).encode()) for i in range(3)]
    docs = spark.createDataFrame(rows, "d long, t long, text binary")
    # few rows, but many suffixes in each
    reps = docs.select("d", "t", F.explode(F.expr("sequence(0L, 300L)")).alias("x")) \
        .selectExpr("d", "t", "x", "x as lo", "x as hi", "x as g", "x as u", "false as res")
    auto = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(auto)
    spark.conf.set(auto, "-1")
    try:
        found = repeats._contexts(docs, reps)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["d"], r["x"]): bytes(r["ctx"]) for r in found.select("d", "x", "ctx").collect()}
    finally:
        spark.conf.set(auto, old)
    assert "BroadcastHashJoin" not in plan
    assert got == {(d, x): t[x:x + repeats.WINDOW] for d, _, t in rows for x in range(301)}


def test_repeats_query_shows_what_is_kept(spark):
    from epiframe.llm.queries import QUERIES
    out = QUERIES["op10_repeats"](spark, SF)
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.collect():
        assert r["n_bytes"] == len(docs[r["doc_id"]].encode())
        if r["n_removed"] == 0:
            assert r["text"] == docs[r["doc_id"]]
        elif "\ufffd" not in r["text"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
