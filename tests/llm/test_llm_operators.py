"""The dealt operators against brute force, exact round trips, held-out accuracy and hard rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from llm_brute import brute_components
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, fingerprint, html_text, jaccard_join, language, licenses, packing, pii, quality, queries, urls

DOCS = "doc_id long, text string"
HARD = [
    (1, None), (2, ""), (3, "one"), (4, "A b C d"), (5, "a B c d"), (6, "x " * 30_000), (7, "same words here again and again"), (7, "same words here again and again"),
    (8, "…!? \t\n"), (9, "日本語のテキスト です 12 34"), (10, "z" * 50_000), (None, "no id at all for this row"), (11, "1" * 40_000),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, "en", "s", 1, "clash") for r in HARD], DOCS + ", lang string, source string, n_chars long, hash string").coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long, hash string")


# --- 1


def test_fingerprints(spark, tables):
    got = queries.op1_document_fingerprints(spark, tables).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False)
    texts = docs.text.tolist()
    for i, t, n in zip(docs.doc_id, texts, texts[1:] + texts[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got.edited_sha256[i] == hashlib.sha256(e.encode()).hexdigest()
        assert got.n_chars[i] == len(t)
    assert (got.near_edited >= got.near_next).mean() > 0.99
    one = dict(zip(docs.text, docs.doc_id, strict=True))
    assert all(got.fingerprint[i] == got.fingerprint[one[t]] for i, t in zip(docs.doc_id, texts, strict=True))


def test_fingerprint_estimates():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 64, 4000, np.uint64), None
    b = np.concatenate([a[:3000], r.integers(0, 1 << 64, 1000, np.uint64)])
    x, y = fingerprint.smallest(a), fingerprint.smallest(b)
    assert abs(fingerprint.resemblance(x, y) - 0.6) < 0.15
    assert abs(fingerprint.containment(x, y) - 0.75) < 0.15
    assert abs(fingerprint.distinct(x) / 4000 - 1) < 0.3
    assert (fingerprint.merge(x, y) == fingerprint.smallest(np.concatenate([a, b]))).all()
    assert (fingerprint.read(fingerprint.written(x)) == x).all()
    repeated = np.repeat(r.integers(0, 1 << 63, 200, np.uint64), 50)
    assert (fingerprint.smallest(repeated) == np.unique(repeated)[: fingerprint.K]).all()


def test_fingerprints_of_hard_rows(hard, empty):
    got = fingerprint.neighbour_fingerprints(hard).toPandas()
    assert len(got) == len(HARD) and got[["near_edited", "near_next"]].apply(lambda c: c.between(0, 1)).all().all()
    order = sorted(HARD, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or ""))
    want = collections.Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        want[i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert want == collections.Counter((None if pd.isna(i) else int(i), s) for i, s in zip(got.doc_id, got.edited_sha256, strict=True))
    assert fingerprint.neighbour_fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(hard).columns[-2:] == ["fingerprint", "n_shingles_est"]


# --- 2


def test_language(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    got = got.merge(truth, on="doc_id")
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_language_of_hard_rows(hard, empty):
    model = language.fit(hard)
    got = language.identify(hard, model).toPandas()
    assert len(got) == len(HARD) and {"lang", "lang_pred", "hash"} <= set(got.columns)
    bare = got.text.fillna("").map(lambda t: not any(c.isalpha() for c in t))
    assert ((got.lang_pred == "und") == bare).all() and got[bare].lang_rejected.all() and (got[bare].lang_score == 0).all()
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert set(language.identify(hard, language.fit(empty)).toPandas().lang_pred) == {"und"}


def test_other_scripts_are_rejected(spark):
    words = "the cat sat on a mat and then went out to see what was there in the wide green field".split()
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(60)), "en") for i in range(60)], DOCS + ", lang string")
    other = spark.createDataFrame([(1, "これは全く別の言語で書かれた長い文章です" * 5), (2, " ".join(words))], DOCS)
    got = language.identify(other, language.fit(docs)).toPandas().set_index("doc_id")
    assert got.lang_rejected[1] and not got.lang_rejected[2]


def test_languages_of_copies_are_learned(spark):
    """Each language is many copies of one text; none may be missed, and all rows count for document frequencies."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, t, f"l{j:02d}") for j in range(10) for t in [" ".join(word() for _ in range(12))] for i in range(40)]
    rows += [(i, " ".join(word() for _ in range(12)), "many") for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, DOCS + ", lang string").repartition(3), rows=10)
    assert set(model.names) == {x[2] for x in rows}
    data = [np.frombuffer(x[1].encode(), np.uint8) for x in rows]
    df = (language.counts(np.concatenate(data), np.cumsum([0, *map(len, data)])) > 0).sum(0)
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 0.1, atol=1e-5)


# --- 3

PAGE = """<html><head><title>T</title></head><body><header class="site-header"><a href=/>Home</a><p>A line about us</p></header>
<div id="cookie-notice">We use cookies, as all do. <button>OK</button></div><nav><ul><li><a>x</a></li></ul></nav><div class="layout"><main><article><header><h1>Title
 here</h1></header><p>One para,<br>with stuff.<p>Two &lt; three&amp;x.</p><div class="ad">Buy now!</div><ul><li>Item one of the list.</li></ul>
<form><label>mail</label><input></form><section id="comments"><h2>Comments</h2><p>Nice article, thanks a lot, really. Good one.</p></section></article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a>aa</a></li></ul></aside></div><footer>&copy; me</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_extraction(spark):
    model = html_text.train()
    assert model.text(PAGE) == "Title here\n\nOne para, with stuff.\n\nTwo < three&x.\n\nItem one of the list."
    assert model.text(None) == model.text("") == model.text("<p></p>") == ""
    assert model.text("<article><p>Left open, with some more text in it.<script>x") == "Left open, with some more text in it."
    assert "no end" in model.text("<article><p>There is no end to this, as it were" + " and so on" * 9000 + " no end.</p></article><p")
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = html_text.extract(pages, model).toPandas()
    assert got.n_chars.tolist() == [len(t) for t in got.text] and len(got) == 3
    assert html_text.extract(pages.limit(0), model).count() == 0


def test_open_elements_do_not_swallow_the_page():
    model = html_text.train()
    article = "<article><h1>A title here</h1><p>One sentence, with some words in it.</p><p>Another one follows, it is as long.</p></article>"
    want = "A title here\n\nOne sentence, with some words in it.\n\nAnother one follows, it is as long."
    assert model.text(f"<html><head><title>T</title></head><body>{article}</body></html>") == want
    for start in ("<head><title>T</title><body>", "<head><meta charset=x><link href=y>", "<head><title>T<body>", "<head></head><body>"):
        assert model.text(f"<html>{start}{article}</html>") == want, start
    assert model.text("<head><title>T</title>Bare text, as long as a sentence is, with no element around it.") == "Bare text, as long as a sentence is, with no element around it."
    for name in ("video", "audio", "canvas", "svg", "iframe", "textarea", "object", "math", "noscript", "template"):
        assert model.text(f"<body>{article.replace('<p>Another', f'<{name} src=x><p>Another')}</body>") == want, name
    assert model.text("<article><p>Let <math><mi>x</mi></math> be a number, and <object data=y>so on</object> for all.</p></article>") == "Let x be a number, and so on for all."
    assert model.text(f"<body>{article}<style>p {{") == model.text(f"<body>{article}<script>x<p>") == model.text(f"<body>{article}<!-- <p>x") == want


def test_extraction_of_all_pages(spark, tables):
    got = queries.op3_html_extraction(spark, tables).toPandas()
    pages = spark.read.parquet(f"{tables}/pages.parquet").toPandas().set_index("page_id")
    import html

    for i, text in zip(got.page_id, got.text, strict=True):
        inner = pages.html[i].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        assert text == "\n\n".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())


def test_long_and_deep_pages_take_time_in_proportion():
    """A page of 50,000 blocks and one of 20,000 open elements; nothing is dropped."""
    import time

    model = html_text.train()
    line = "A sentence of the article, which goes on for a while, and then ends."
    began = time.time()
    long_page = "<nav class=menu><ul>" + "<li><a href=x>go there</a></li>" * 25_000 + "</ul></nav><article>" + f"<p>{line}</p>" * 25_000 + "</article>"
    assert model.text(long_page) == "\n\n".join([line] * 25_000)
    deep_page = f"<div>{line}" * 20_000 + "</b></p></div>" * 20_000
    assert model.text(deep_page) == "\n\n".join([line] * 20_000)
    assert time.time() - began < 30


def test_min_cut_is_minimal():
    r = random.Random(4)
    for _ in range(30):
        n = 7
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda keep: sum(max(0, o) if not k else max(0, -o) for o, k in zip(odds, keep, strict=True)) + sum(w for i, j, w in edges if keep[i] != keep[j])  # noqa: E731, B023
        assert cost(html_text.min_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))), abs=1e-6)


# --- 4


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    held = labels.where(part < 3)
    judges = quality.fit(docs, labels.where(part >= 3))
    got = quality.score(docs.join(held.select("doc_id"), "doc_id"), judges).toPandas().merge(held.toPandas(), on="doc_id", suffixes=("", "_true"))
    assert (got.quality == got.quality_true).mean() > 0.95
    assert got[got.toxic_true == 1].toxic.mean() > 0.7 and got[got.toxic_true == 0].toxic.mean() < 0.04


def test_exchange_teaches_words_that_no_labelled_row_has(spark):
    """Without rounds the unlabelled documents' words are noise; with them the metadata view teaches the text view."""
    r = random.Random(4)
    known = {1: "clear sound proof brief exact".split(), 0: "prize click offer deals quick".split()}
    new = {1: "lemma axiom graph field prime".split(), 0: "bonus lotto promo token gifts".split()}
    rows, labels = [], []

    def add(words, source):
        rows.append((len(rows), " ".join(r.choice(words) for _ in range(12)), source, "en"))
        return len(rows) - 1

    for i in range(300):
        y = i % 2
        labels.append((add(known[y], f"s{y}"), y, 0))
    for i in range(600):
        add(new[i % 2], f"s{i % 2}")
    asked = [(add(new[i % 2], "elsewhere"), i % 2) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    right = {}
    for rounds in (0, 2):
        got = quality.score(docs, quality.fit(docs, labels, rounds=rounds)).toPandas().set_index("doc_id").quality
        right[rounds] = np.mean([got[i] == y for i, y in asked])
    assert right[0] < 0.75 and right[2] > 0.9


def test_exchange_counts_all_unlabelled_documents(spark):
    """Sums over partitions equal a plain count."""
    rows = [(i, np.array([i % 3, 7], "<u2").tobytes(), np.array([5 if i % 2 else 6], "<u2").tobytes()) for i in range(500)]
    free = spark.createDataFrame(rows, "doc_id long, text_view binary, meta_view binary").repartition(5)
    w = np.zeros(quality.META_DIMS)
    w[5], w[6] = 9.0, -9.0
    judge = quality.Judge(quality.Linear(np.zeros(quality.TEXT_DIMS), 0.0), quality.Linear(w, 0.0))
    ((text, meta),) = quality.exchange(free, [judge])
    assert text[:, -1].tolist() == [250, 250] and not meta.any()
    for label in (0, 1):
        mine = [i for i in range(500) if i % 2 == label]
        assert text[label, :3].tolist() == [sum(i % 3 == j for i in mine) for j in range(3)] and text[label, 7] == 250


def test_quality_of_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, None), (6, 0, 1), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(hard, quality.fit(hard, labels)).toPandas()
    assert len(got) == len(HARD) and got.score.between(0, 1).all()
    none = quality.score(hard, quality.fit(hard, labels.limit(0))).toPandas()
    assert (none.score == 0.5).all() and none.keep.all()
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


# --- 5


def test_packing_round_trip(spark, tables):
    from tokenizers import Tokenizer

    got = queries.op5_best_fit_packing(spark, tables).toPandas()
    tok = Tokenizer.from_file(packing.public_path())
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").toPandas()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= got.length.sum() / 4096 * 1.02 + 1


def test_words_make_texts():
    w = packing.WordIds(packing.public_path())
    r = random.Random(1)
    texts = ["".join(r.choice("aA'sStT.,!<|>éÉßİΣς 1９́\n\t\x1c\xa0日本") for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["don't DON'T. x's' <|endoftext|> a<|endoftext|>!", "ΑΣ ΑΣ. é ' ''"]
    for t, ids in zip(texts, w.ids(texts), strict=True):
        assert ids == np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), ascii(t)


def test_best_two_fit():
    r = random.Random(2)
    for _ in range(20):
        lengths = np.array([r.randint(1, 100) for _ in range(r.randint(1, 200))])
        seq, off = packing.best_two_fit(lengths, 100)
        for s in set(seq):
            own = sorted(zip(off[seq == s], lengths[seq == s], strict=True))
            assert sum(n for _, n in own) <= 100 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own))
    # greedy takes 60 and 30; the 30 gives way to 25 and 15, which fill the sequence
    seq, _ = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert seq[0] == seq[2] == seq[3] != seq[1]


def test_packing_of_hard_rows(hard, empty):
    got = packing.pack(packing.pieces(hard, with_ids=True))
    assert got.where("doc_id in (1, 2)").select("length").toPandas().length.tolist() == [1, 1]
    seqs = packing.sequences(got).toPandas()
    assert seqs.length.sum() == got.agg(F.sum("length")).first()[0] and seqs.length.max() <= 4096
    assert packing.pack(packing.pieces(empty)).count() == 0


# --- 6


def near_copies(seed, n=220):
    """Short and long texts, near and exact copies around the threshold, shared passages."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(20)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts)[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                if w:
                    p = r.randrange(len(w))
                    w[p : p + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
            texts.append(w)
        else:
            texts.append([r.choice(words) for _ in range(r.choice([1, 3, 5, 6, 8, 12, 40, 120]))] + (passage if r.random() < 0.3 else []))
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = near_copies(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).toPandas()
    assert sorted(zip(got.doc_id, got.n_shingles, got.component_id, strict=True)) == sorted(brute_components(rows))


def test_signatures_cover_all_links():
    r = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 7, 10, 15, 23, 40, 75, 150, 320, 900):
        for _ in range(60):
            base = r.integers(0, 1 << 64, size + size // 3 + 2, np.uint64)
            a = np.unique(base[:size])
            drop = int(r.integers(0, size // 4 + 1))
            b = np.unique(np.concatenate([a[drop:], base[size : size + int(r.integers(0, size // 3 + 1))]]))
            i = np.intersect1d(a, b).size
            if len(b) and 100 * i >= 75 * (len(a) + len(b) - i):
                sig, own = jaccard_join.signatures([a, b])
                assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist()), (size, len(a), len(b), i)
                both, one, other = [jaccard_join.sketch(a), jaccard_join.sketch(b)], np.array([0]), np.array([1])
                assert jaccard_join._alike(both, one, other, np.array([len(a) + len(b) - 2 * i])).all()


def test_runs_dealt_over_blocks(spark, monkeypatch):
    """Every member differs from every other; signatures are shared by many, and runs are dealt over blocks."""
    monkeypatch.setattr(jaccard_join, "RUN_BLOCK", 50)
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        w = base[:]
        for p in r.sample(range(60), r.choice([1, 1, 2, 2, 3])):
            w[p] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).toPandas()
    assert sorted(zip(got.doc_id, got.n_shingles, got.component_id, strict=True)) == sorted(brute_components(rows))


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102)]
    got = {x["node"]: x["component"] for x in jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100 and got[103] == 102


def test_jaccard_of_hard_rows(hard, empty):
    got = jaccard_join.jaccard_components(hard).toPandas()
    want = collections.Counter(brute_components(HARD))
    assert want == collections.Counter((None if pd.isna(i) else int(i), n, None if pd.isna(c) else int(c)) for i, n, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True))
    kept = jaccard_join.one_of_each(hard).toPandas()
    assert sorted(kept.doc_id.dropna().astype(int)) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11] and "hash" in kept.columns
    assert jaccard_join.jaccard_components(empty).count() == jaccard_join.one_of_each(empty).count() == 0


# --- 7


def brute_base(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in pats.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans():
    r = random.Random(6)
    for _ in range(4000):
        t = "".join(r.choice(["a", "@", ".", "1", "25", "+", " ", "-", "(", ")", "é", "b.c", "4111111111111111", "x@y.z", "1.2.3.4"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute_base(t), t


def test_pii_of_all_documents(spark, tables):
    got = queries.op7_pii(spark, tables).toPandas().set_index("doc_id")
    for i, t in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False):
        base = brute_base(t)
        assert got.base_sha256[i] == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        assert [got[f"n_{k}"][i] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert {pii.spelled([b]) for b in base} <= set(got.spans[i].split(","))


def test_skip_edges_carry_labels():
    """A number without its plus, far from a full mention of it, is found through the edge between them; another is not."""
    r = random.Random(2)
    fill = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet".split()) for _ in range(n))
    model = pii.train([f"{fill(9)} +1 (98{i % 10}) 555-2{i:03d} {fill(9)} room 12{i} {fill(4)}" for i in range(80)])
    far = f"{fill(6)} +1 (455) 555-2199 {fill(40)} "
    base = pii.base_spans(far)
    assert len(base) == 1
    alone = model.added(f"{fill(20)} 5552199 {fill(5)}", [])
    model.skip[4, 4] = 30.0
    with_edge = model.marginals([["call", "+14555552199", "now"], ["or", "14555552199", "then"]])
    without = model.marginals([["call", "nobody", "now"], ["or", "14555552199", "then"]])
    assert not alone and with_edge[1][1][4] > without[1][1][4]


def test_one_sure_mention_reaches_all_others():
    """Dozens of mentions in another format follow a full one; the last hears of it too."""
    sure, weak, kind = ["call", "+14555552199", "now"], ["or", "14555552199", "then"], 1 + pii.KINDS.index("phone")
    other = ["call", "nobody", "now"]
    own = lambda s: set(pii._features(s, 1)) - {f for x in (sure, weak, other) for i in range(3) if (x, i) != (s, 1) for f in pii._features(x, i)}
    model = pii.train([])
    model.unary[:] = 0
    model.unary[zlib.crc32(b"b") % pii.BUCKETS, 1:] = -20
    model.unary[min(own(sure)), kind] = 28
    model.unary[min(own(weak)), kind] = 14
    for n in (3, 40, 1000):
        heard, alone = (model.marginals([first, *[weak] * n]) for first in (sure, other))
        # the last has a tie on one side only
        assert alone[n][1][kind] < 0.1 and heard[n][1][kind] > 0.8 and all(h[1][kind] > 0.9 for h in heard[1:n])


def test_fit_reads_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda texts: texts)
    far = " ".join(f"room {i} and then some more words" for i in range(60)) + " call 5552199 now"
    wide = " ".join(str(i) for i in range(2000)) + " 5552199"
    assert all("5552199" in t for t in pii.fit(spark.createDataFrame([(1, far), (2, wide)], DOCS)))


def test_redaction_of_hard_rows(hard, empty, spark):
    model = pii.fit(hard)
    assert len(pii.find_pii(hard, model).toPandas()) == len(HARD)
    docs = spark.createDataFrame([(1, "mail a.b@c.de now, 10.0.0.1!"), (2, None)], DOCS)
    assert [x["text"] for x in pii.redact(docs, pii.train([])).orderBy("doc_id").collect()] == ["mail [EMAIL] now, [IP]!", None]
    assert pii.find_pii(empty, pii.fit(empty)).count() == 0


# --- 8


def test_decontamination_matches_sql(spark, tables, oracle, as_rows):
    ours = queries.op8_benchmark_decontamination(spark, tables).toPandas()
    assert as_rows(ours) == as_rows(oracle.execute(decontaminate.ORACLE_SQL).df())


def test_decontamination_of_hard_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, "x x x"), (2, "same WORDS here"), (3, None), (4, ""), (5, "nowhere to be found"), (6, "の"), (2, "no id")], "item_id long, text string")
    got = decontaminate.decontaminate(hard, items).toPandas()
    assert len(got) == len(HARD)
    by = got.set_index("doc_id")
    assert by.n_hit[6] == by.n_words[6] == 30_000 and by.n_items[6] == 1 and by.contaminated[6]
    assert (by.n_hit[7] == 3).all() and by.contaminated[7].all() and by.n_words[1] == 0 and not by.contaminated[1]
    assert got[got.doc_id.isna()].n_hit.tolist() == [2]
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert not decontaminate.decontaminate(hard, items.limit(0)).toPandas().contaminated.any()


def test_shuffled_joins_give_the_same(spark, tables, monkeypatch, as_rows):
    docs, items = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    want = as_rows(decontaminate.decontaminate(docs, items).toPandas())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate.broadcastable, "__defaults__", (0,))
    assert as_rows(decontaminate.decontaminate(docs, items).toPandas()) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta three gamma"), (2, "alpha " + "w " * 50 + "beta gamma"), (3, None)], DOCS)
    items = spark.createDataFrame([(9, "gamma beta alpha")], "item_id long, text string")
    counts = decontaminate.term_counts(docs, spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "term string"))
    assert [tuple(x)[::2] for x in decontaminate.near_hits(docs, items, counts, distance=10).collect()] == [(1, "9")]


# --- 9


def brute_url(url):
    rest = url.partition("://")[2] if url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = re.split(r"[?#]", rest[cut:])[0]
    rule = None
    for r in ("example.com/de/", "example.net/en/", "org/fr/", "net/"):
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            rule = r
            break
    return host, path, rule


def test_urls(spark):
    r = random.Random(7)
    hosts = ["net", "a.net", "xnet", "example.net", "EXAMPLE.net", "b.example.com", "org", "W.org", "", "É.net"]
    data = [(i, f"{r.choice(['http://', 'https://', '', '//', '://'])}{r.choice(hosts)}{r.choice(['', '/', '/en/1', '/de/', '/fr/x?y=://z', '?q', '#a/b', '/en'])}") for i in range(300)] + [(300, None), (301, "http://a.net/\nb#x")]
    got = urls.judge(spark.createDataFrame(data, "page_id long, url string")).toPandas().set_index("page_id")
    for i, u in data:
        assert (got.host[i], got.path[i], got.rule[i]) == brute_url(u), u
        if got.rule[i]:
            assert got.verdict[i] == dict(urls.RULES)[got.rule[i]]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model():
    """Known words in new names, and names none of whose words were in training."""
    m = urls.fit(urls.training_urls())
    other = urls.training_urls(seed=10)
    assert np.mean([(m.score(*urls.split(u)) > 0.5) == bool(y) for u, y in other.itertuples(index=False)]) > 0.95
    right = []
    for fold in range(5):
        m = urls.fit(urls.training_urls(-1 - fold))
        held = urls.training_urls(fold, 60)
        right += [(m.score(*urls.split(u)) > 0.5) == bool(y) for u, y in held.itertuples(index=False)]
    assert np.mean(right) > 0.6
    with pytest.raises(ValueError):
        urls.fit(pd.concat([other] * 20))


def test_url_folds_share_no_word():
    letters = lambda fold: {w for u in urls.training_urls(fold, 100).url for w in re.findall("[a-z]+", urls.split(u)[0])}
    kinds = set(urls.BAD.split()) | set(urls.GOOD.split())
    for fold in range(5):
        assert letters(fold) & letters(-1 - fold) & kinds <= {"news"}  # which is a prefix of hosts too


# --- 10


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    at = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses(spark, tables):
    r = random.Random(8)
    bits = ["under the", "MIT", "License", "under the MIT License.", "Apache License, Version 2.0", "CC BY-NC", "CC-BY NC-SA 4.0", "text é", "GNU General Public License, version 3", "\n", "SPDX-License-Identifier: MIT"]
    data = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(300)]
    data += [(1000 + i, t) for i, t in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False)] + [(-1, None)]
    got = licenses.scan_licenses(spark.createDataFrame(data, DOCS)).toPandas().set_index("doc_id")
    for i, t in data:
        x = got.loc[i]
        assert (x.n_words, x.n_base, None if pd.isna(x.first_word) else x.first_word, None if pd.isna(x.last_word) else x.last_word, x.base_labels) == brute_license(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_license_rules():
    found = lambda t: {x[2] for x in licenses.detections(t)}
    assert found("this work is licensed under the gnu general public license version 3") == {"gpl-3"}
    assert found("gnu lesser general public license v2 1 or later") == {"lgpl-2.1"}
    assert found("licensed under cc by nc sa 4 0") == {"cc-by-nc-sa"}
    assert found("the mitigation of licensed trade") == set()
    assert len(licenses.rules()) > 200
    assert all(licenses.GATE.search(r.keyword) for r in licenses.rules()) and all(licenses.GATE.search(p) for p, _ in licenses.BASE)


def test_short_names_without_a_version():
    found = lambda t: {x[2] for x in licenses.detections(t)}
    for name, label in (("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gfdl", "fdl"), ("mpl", "mpl"), ("epl", "epl"), ("cddl", "cddl"), ("eupl", "eupl"), ("odbl", "odbl")):
        assert found(f"it is licensed under the {name} and so on") == found(f"governed by the {name}") == found(f"the {name} license") == {label}
        assert found(f"the {name} table") == found(f"licensed under the {name}x") == set()
    assert found("released under the gpl version 3") == {"gpl-3"} and found("available under the mpl 2 0") == {"mpl-2"}


def test_license_notices():
    """Sentences of license texts, the words around them whatever they are; the longer and surer rule wins."""
    found = lambda t: {x[2] for x in licenses.detections(" ".join(re.findall(r"[a-z0-9]+", t.lower())))}
    assert found("Neither the name of Some Company, Inc. nor the names of its contributors may be used to endorse or promote products") == {"bsd-3-clause"}
    assert found("You may not use this file except in compliance with the License.") == {"apache-2"}
    assert found("see https://creativecommons.org/licenses/by-nc-sa/4.0/ there") == {"cc-by-nc-sa"}
    assert found("see https://creativecommons.org/licenses/by-nc/4.0/ there") == {"cc-by-nc"}
    assert found("see https://creativecommons.org/licenses/by/4.0/ there") == {"cc-by"}
    assert found("The origin of this software must not be misrepresented") == {"zlib"}
    assert found("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == {"mpl"}
    assert found("No part of this book may be reproduced. Copyright 2001") == {"all-rights-reserved", "copyright-notice"}
    assert found("Permission is granted to anyone who asks about warranted options and liability in government") == set()
    assert found("The Software shall be used for Good, not Evil. It is licensed so.") == {"json"}


def test_licenses_of_hard_rows(hard, empty):
    assert len(licenses.scan_licenses(hard).toPandas()) == len(HARD)
    assert licenses.scan_licenses(empty).count() == 0


# --- skewed inputs of the packing and the join


def test_packing_deals_one_hot_id(spark):
    """Rows of one id, and one row many times, are dealt over the groups like others."""
    rows = spark.range(4_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a few words").alias("text"))
    got = packing.pack(packing.pieces(rows), group=500)
    per_group = got.groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).count().toPandas()
    assert per_group["count"].sum() == 4_000 and len(per_group) == 8 and per_group["count"].max() < 700
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_words_are_encoded_as_their_text():
    tok = packing.WordIds(packing.public_path())
    texts = ["it's, don't… x…, 12, 3.5% a\x01b \x01 çé… 'll a'ss's ʼs’s ² ½. ①!", "Σίσυφος ΣΑΣ. İstanbul,  x y \t z\tw", "--- ,,,'s 's'. ́a , ́, é,", "日本語、 テ。ス, ،،", "a" * 300 + "!" * 80, ""]
    for _ in range(2):  # the second time from what is known
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.ids(texts)] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_large_group_of_near_copies(spark, monkeypatch):
    """Exact components of many near copies, and no more than a few compared pairs a member."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 6)):
            w[at] = f"x{rng.integers(1_000_000)}"
        rows.append((i, " ".join(w)))
    compared = []
    verified = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: (compared.append(pairs.count()), verified(pairs, *a))[1])
    monkeypatch.setattr(jaccard_join, "SMALL_RUN", 20)
    monkeypatch.setattr(jaccard_join, "RUN_BLOCK", 100)
    docs = spark.createDataFrame(rows, DOCS)
    got = jaccard_join.jaccard_components(docs).toPandas().set_index("doc_id").component_id.to_dict()
    assert got == {i: c for i, _, c in brute_components(rows)}
    assert sum(compared) < 40 * len(rows)


def test_field_adds_cards_in_other_spellings_and_none_that_fail(spark):
    """Spellings that no base pattern takes are found; a number that fails Luhn never is, whatever its neighbours say."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("[0-9@]")).select("text").limit(400).collect()]
    model = pii.train(texts)
    text = "Card 4111-1111-1111-1111. " + "word " * 30 + "again 4111.1111.1111.1111 here, not 4111.1111.1111.1112 there"
    base = pii.base_spans(text)
    assert [text[a:b] for _, a, b in model.added(text, base)] == ["4111.1111.1111.1111"]
    assert all(pii.luhn("".join(c for c in t[a:b] if c.isdigit())) for t in texts for k, a, b in model.added(t, pii.base_spans(t)) if k == "card")
