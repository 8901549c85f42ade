"""Operators 11 to 13: brute force, exact rules, held-out accuracy and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.llm import divergence, gam, vectorcodes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- 11 ------------------------------------------------------------------------

def brute_divergences(rows, min_df=3, top=200):
    """rows of (text, lang, source) -> {(lang, source, part, rank): (item, value)}."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
                        "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), lg or "", s or "")
            for t, lg, s in rows]
    out = {}
    for lang in {d[1] for d in docs}:
        df, n = Counter(), defaultdict(Counter)
        for w, lg, s in docs:
            if lg == lang:
                df.update(set(w))
                n[s].update(w)
        kept = [t for t in df if df[t] >= min_df]
        whole = Counter()
        for c in n.values():
            whole.update({t: c[t] for t in kept})

        def p(c, t):
            total = sum(c[x] for x in kept) + len(kept)
            return 1 + 1_000_000_000 * (c[t] + 1) // total

        for s in n:
            pair = [(-sum((p(n[s], t) - p(n[o], t)) ** 2 // p(n[o], t) for t in kept), o.encode(), o)
                    for o in n if o != s]
            term = [(-((p(n[s], t) - p(whole, t)) ** 2 // p(whole, t)), t.encode(), t) for t in kept
                    if n[s][t] > 0 and p(n[s], t) > p(whole, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                for r, (v, _, item) in enumerate(found, 1):
                    out[lang, s, part, r] = (item, -v)
    return out


def divergences_of(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, lg, s, 0) for i, (t, lg, s) in enumerate(rows)], DOC)
    got = divergence.source_divergences(df, **kw).collect()
    out = {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in got}
    assert len(out) == len(got)
    return out


def odd_documents():
    rng = random.Random(4)
    vocab = ["Alpha", "beta", "GAMMA", "Ünder", "naïve", "ÉTÉ", "été", "delta", "x1y", "日本", "o'clock"]
    rows = [(" ".join(rng.choices(vocab, k=rng.randint(0, 12))), rng.choice(["en", "fr", None, ""]),
             rng.choice(["a", "b", "c", "", None])) for _ in range(120)]
    rows += [(None, "en", "only-null"), ("", "de", "s"), ("1 2 3 !", "de", "t"), ("rare words here", "it", "s"),
             ("rare words here", "it", "s"), ("lonely", "pt", "one")]
    rows += [("hot Ünder " * 400, "en", "a")] * 5
    return rows


def test_divergences_equal_brute_force_on_odd_rows(spark):
    rows = odd_documents()
    want = brute_divergences(rows)
    assert divergences_of(spark, rows) == want
    assert ("de", "s", "pair", 1) in want and want["de", "s", "pair", 1] == ("t", 0)
    assert not any(k[0] == "pt" for k in want) and not any(k[:3] == ("it", "s", "pair") for k in want)


def test_divergences_do_not_depend_on_spills_or_kernel_sizes(spark, monkeypatch):
    rows = odd_documents()
    want = brute_divergences(rows, min_df=2, top=3)
    monkeypatch.setattr(divergence, "MAX_ENTRIES", 5)
    monkeypatch.setattr(divergence, "MAX_PAIRS", 3)
    monkeypatch.setattr(divergence, "LONG_TEXT", 50)
    assert divergences_of(spark, rows, min_df=2, top=3) == want


def test_divergences_many_sources_clashing_names_and_empty_table(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choices([f"w{chr(97 + i)}" for i in range(20)], k=30)), "en", f"s{rng.randint(0, 60)}")
            for _ in range(300)]
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], DOC) \
        .withColumns({c: F.lit("clash") for c in ("term", "entries", "item", "value", "rank", "n", "df", "s", "v")})
    got = {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"])
           for r in divergence.source_divergences(df).collect()}
    assert got == brute_divergences(rows)
    assert divergence.source_divergences(df.limit(0)).count() == 0


def test_probability_is_exact_beyond_32_bits(spark):
    cases = [(0, 1), (7, 9), (123_456_789_012, 987_654_321_098), (10 ** 13, 3 * 10 ** 13 + 7)]
    got = spark.createDataFrame(cases, "n long, m long").select(
        "n", "m", divergence.probability(F.col("n"), F.col("m")).alias("p")).collect()
    for r in got:
        assert r["p"] == 1 + 1_000_000_000 * (r["n"] + 1) // r["m"]


# --- 12 ------------------------------------------------------------------------

def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows of (id, vector of whole numbers) -> ({row index: (code, error)}, books)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    dim = len(rows[0][1])
    w = -(-dim // parts)
    cut = [(min(p * w, dim), min(p * w + w, dim)) for p in range(parts)]
    books = [[list(rows[i][1][a:b]) for i in order[:entries]] for a, b in cut]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            own = defaultdict(list)
            for _, v in rows:
                own[near(v[a:b], books[p])[1]].append(v[a:b])
            for e, vs in own.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    out = []
    for _, v in rows:
        got = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append(("".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
    return out, books


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(2)
    for dim, spread in ((16, 3.0), (8, 0.001), (13, 1.0), (64, 0.2)):
        x = rng.normal(0, spread, (150, dim))
        x[40:90] = x[3]                              # a hot vector
        x[100:110, : dim // 2] = x[5, : dim // 2]    # ties in some parts
        rows = [(int(i), v) for i, v in zip(rng.permutation(150), x.tolist())]
        df = spark.createDataFrame([(i, v, i % 3 or None) for i, v in rows],
                                   "vec_id long, embedding array<double>, label int")
        out, books = vectorcodes.compress_vectors(df)
        whole = [(i, [int(np.floor(4096 * c)) for c in v]) for i, v in rows]
        want, want_books = brute_codes(whole)
        got = {r["vec_id"]: r for r in out.collect()}
        assert {i: (got[i]["code"], got[i]["error"]) for i, _ in rows} == {r[0]: w for r, w in zip(rows, want)}
        assert [b.tolist() for b in books] == want_books
        per = Counter()
        for (i, _), (_, e) in zip(rows, want):
            per[i % 3] += e
        assert all(got[i]["label_error"] == per[i % 3] for i, _ in rows)
        text = ",".join(str(c) for b in want_books for row in b for c in row)
        assert vectorcodes.codebooks_digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [-0.25] * 8, None), (2, None, 1), (3, [nan] * 8, 1),
            (4, [inf] + [0.0] * 7, 1), (5, [None] + [0.0] * 7, 1), (6, [1.0] * 4, 2), (7, [1e300] * 8, 2), (8, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int") \
        .withColumns({c: F.lit("clash") for c in ("rid", "q", "code", "error", "part", "l")})
    out, books = vectorcodes.compress_vectors(df)
    got = sorted(out.collect(), key=str)
    assert len(got) == 6 and len(books[0]) == 3
    assert [(r["vec_id"], r["error"]) for r in got if r["code"] is not None and r["vec_id"] == 1] == [(1, 0)] * 2
    assert {r["vec_id"] for r in got if r["code"] is None} == {6, 7, 8}
    assert vectorcodes.compress_vectors(df.limit(0))[0].count() == 0
    only_odd, books = vectorcodes.compress_vectors(df.where("vec_id = 8"))
    assert [(r["code"], r["error"]) for r in only_odd.collect()] == [("00" * 8, 0)]


def test_hilbert_keys_visit_neighbouring_cells():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
        key = vectorcodes.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_the_nearest_entry_of_every_row():
    rng = np.random.default_rng(0)
    short = 0
    for _ in range(200):
        book = rng.integers(-50, 50, (16, 4))
        x = rng.integers(-50, 50, (1, 4)) + rng.integers(-6, 7, (20, 4))
        among = vectorcodes.shortlist(x.min(0), x.max(0), book)
        full = ((x[:, None] - book) ** 2).sum(2)
        best, d = vectorcodes.nearest(x, book, among)
        assert (best == full.argmin(1)).all() and (d == full.min(1)).all()
        short += len(among) < 16
    assert short > 150


# --- 13 ------------------------------------------------------------------------

def test_tree_on_bins_takes_the_best_first_cut():
    rng = np.random.default_rng(1)

    def worth(g, h):
        return g.sum() ** 2 / (h.sum() + gam.RIDGE)

    for _ in range(30):
        g, h, n = rng.normal(0, 5, 12), rng.uniform(1, 4, 12), np.full(12, 10.0)
        step = gam.tree_on_bins(g, h, n, leaves=2)
        at = max(range(1, 12), key=lambda c: worth(g[:c], h[:c]) + worth(g[c:], h[c:]))
        want = np.r_[np.full(at, -g[:at].sum() / (h[:at].sum() + gam.RIDGE)),
                     np.full(12 - at, -g[at:].sum() / (h[at:].sum() + gam.RIDGE))]
        if worth(g[:at], h[:at]) + worth(g[at:], h[at:]) > worth(g, h):
            assert step == pytest.approx(want)


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert (0, 1) in model.pairs
    flat = gam.Model(model.edges, model.intercept, model.tables)
    assert ((flat.score(x[2000:]) >= 0.5) == y[2000:]).mean() < 0.65


def test_scores_add_up_by_hand():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 3))
    model = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int))
    for row, s in zip(x[:40], model.score(x[:40])):
        b = [sum(v >= e for e in model.edges[f]) for f, v in enumerate(row)]
        z = model.intercept + sum(model.tables[f][b[f]] for f in range(3))
        z += sum(t[model.coarse[f][b[f]], model.coarse[g][b[g]]] for (f, g), t in model.pairs.items())
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = gam.quality_scores(docs, labels)
    got = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert {r["doc_id"] for r in out.collect()} == set(ids) and out.count() == len(ids)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out.collect())


def test_classifier_reads_no_label_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, gam.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b
    moved = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    assert sorted(map(tuple, gam.quality_scores(moved, labels).collect())) == a


def test_classifier_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (3, "some words"), (3, "some words"), (4, "x " * 300_000),
            (5, "!!! *** ###"), (6, "\n\n\n"), (7, "ÿ" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumns({c: F.lit("clash") for c in ("x", "y", "h", "r", "score", "predicted", "_lid", "quality")})
    labels = spark.createDataFrame([(3, 1), (5, 0), (4, None), (None, 1), (6, 7)], "doc_id long, quality int")
    got = gam.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["score"])
    assert by[1] == by[2] and by[None] == by[3]
    none = gam.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert gam.quality_scores(docs.limit(0), labels).count() == 0
