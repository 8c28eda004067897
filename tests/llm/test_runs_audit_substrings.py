"""Periodic runs, the filter audit and substring dedup against brute force and on hard rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import filter_audit, periodic, queries, substrings

DOCS = "doc_id long, text string, source string, runs string, kept string, hash long"
LOOP = " ".join(f"w{i}" for i in range(9))
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "x " * 30_000), (6, " ".join([LOOP] * 40)), (7, "A " + " ".join([LOOP] * 4)), (7, "A " + " ".join([LOOP] * 4)),
    (8, " ".join(f"u{i}" for i in range(40_000))), (9, "z" * 100_000), (None, " ".join([LOOP] * 5)), (None, None), (10, "日本 語 の　テキスト " * 12), (7, "another text with the key of seven # 12"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "s", "clash", "clash", 1) for i, t in HARD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11


def brute_runs(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_looped(i, w):
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if i is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def brute_row(i, text, loop=True):
    w = brute_looped(i, words(text)) if loop else words(text)
    found = brute_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def as_row(r):
    return tuple(None if x is None or x != x else x if isinstance(x, str) else int(x) for x in r)


@pytest.mark.parametrize(("least", "times"), [(2, 2), (4, 2), (6, 3), (24, 3), (9, 4)])
def test_runs_equal_brute_force(least, times):
    r = random.Random(least * 10 + times)
    for k in range(120):
        texts = []
        for _ in range(3):
            w = []
            while len(w) < r.choice([0, 5, 30, 90]):
                block = [f"{x}" for x in r.choices("ab" if k % 3 else "abcdefgh", k=r.randint(1, 9))]
                w += block * r.choice([1, 1, 2, 4, 8]) + block[: r.randint(0, len(block))]
            texts.append(" ".join(w))
        got = periodic.text_runs([t.encode() for t in texts], least, times)
        for t, (w, found) in zip(texts, got, strict=True):
            assert [x.decode() for x in w] == t.split() and [tuple(x) for x in found.tolist()] == brute_runs(t.split(), least, times), (t, least, times)


def test_runs_of_binary_words():
    """Fibonacci, Thue-Morse and all short words over two letters: many runs, long common prefixes, none of them lost."""
    a, b = "a", "ab"
    for _ in range(10):
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(256))
    for t in [b, morse, "a" * 70, "ab" * 40 + "a", *("".join(x) for x in itertools.product("ab", repeat=9))]:
        (_, found), (_, other) = periodic.text_runs([" ".join(t).encode(), b"c " * 30], 2, 2)
        assert [tuple(x) for x in found.tolist()] == brute_runs(t, 2, 2) and other.tolist() == [[0, 30, 1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_of_any_blocks(blocks):
    w = [x for block, n in blocks for x in block * n]
    ((_, found),) = periodic.text_runs([" ".join(w).encode()], 8, 3)
    assert [tuple(x) for x in found.tolist()] == brute_runs(w, 8, 3)


def test_run_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_periodic_runs(spark, tables).toPandas()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = {d.doc_id for d in docs if len(words(d.text)) < 1200}
    assert len(got) == len(docs) and len(small) > 150 and (got.n_runs > 0).sum() > 5
    assert sorted(as_row(r) for r in got[columns].itertuples(index=False) if r.doc_id in small) == sorted(brute_row(*d) for d in docs if d.doc_id in small)


def test_loops_are_planted(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i in range(60) for n in (0, 1, 2, 50)]
    got = periodic.looped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [words(r.text) for r in got] == [brute_looped(i, words(t)) for i, t in rows]


def test_runs_of_hard_rows(hard, empty):
    got = periodic.periodic_runs(hard).toPandas()
    assert list(got.columns[:6]) == hard.columns and set(got["runs"]) == {"clash"} and len(got) == len(HARD)
    long = {5, 8}
    by_key = {(None if pd.isna(i) else int(i), t): [tuple(x) for x in f] for i, t, f in zip(got.doc_id, got.text, got["_runs"], strict=True)}
    for i, t in HARD:
        assert by_key[i, t] == ([(0, 30_000, 1)] if i == 5 else [] if i == 8 else brute_runs(words(t)))
    kept = dict(zip(got.doc_id, got.collapsed, strict=True))
    assert kept[5] == "x" and kept[6] == LOOP and kept[1] == kept[2] == kept[3] == ""
    digests = periodic.run_digests(hard).toPandas()
    assert collections.Counter(as_row(r) for r in digests.itertuples(index=False) if r.doc_id not in long) == collections.Counter(brute_row(i, t) for i, t in HARD if i not in long)
    assert periodic.periodic_runs(empty).count() == periodic.run_digests(empty).count() == 0


def test_strongest_run_is_exact(spark):
    rows = [([(5, 30, 10), (0, 27, 9), (2, 27, 9)],), ([(9, 10**9 + 1, 10**8), (1, 10**9, 10**8)],), ([],), (None,)]
    got = spark.createDataFrame(rows, "r array<struct<start:long,length:long,period:long>>").select(periodic.strongest(periodic.F.col("r")).alias("b")).collect()
    assert [tuple(x.b) if x.b else None for x in got] == [(0, 27, 9), (9, 10**9 + 1, 10**8), None, None]


# --- 12


def brute_audit(docs, labels):
    """(part, order, step) -> kept, removed, redundant, unique, good, toxic lost, by applying the filters one after another."""
    fails, parts, out = [], [], {}
    for k, (i, text, part) in enumerate(docs):
        t = text or ""
        w = words(t)
        f = {c for c, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if bad}
        if i is not None and any(j is not None and j < i and (o or "") == t for j, o, _ in docs):
            f.add("E")
        fails.append(f)
        parts.append(part or "")
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    sums = collections.Counter()
    for part in set(parts):
        for order in itertools.permutations("ABCDE"):
            left = [k for k in range(len(docs)) if parts[k] == part]
            gone = []
            for step, c in enumerate(order, 1):
                now = [k for k in left if c in fails[k]]
                out[part, "".join(order), step] = [
                    len(left) - len(now), len(now), sum(c in fails[k] for k in gone), sum(fails[k] == {c} for k in range(len(docs)) if parts[k] == part),
                    sum(docs[k][0] in good for k in now), sum(docs[k][0] in toxic for k in now),
                ]
                sums[part, c] += len(now)
                gone += now
                left = [k for k in left if c not in fails[k]]
    return sorted((*key, *x, sums[key[0], key[1][key[2] - 1]]) for key, x in out.items())


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_query(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, queries.op12_filter_audit(spark, tables).select(*AUDIT).collect())) == brute_audit(docs, labels)


def test_audit_of_hard_rows(spark, hard, empty):
    """Null ids, texts and parts, repeated rows, keys with several texts, labels that are null, repeated or of no row."""
    long = " ".join(f"W{i}" for i in range(300))
    rows = [(i, t, None if i == 4 else "s") for i, t in HARD] + [(20, long, ""), (21, long, "t"), (21, long, "u"), (21, long, "u"), (22, long, None), (20, long, "t"), (30, "", "s")]
    labels = [(20, 1, 0), (20, 0, 1), (21, None, 1), (22, 1, None), (None, 1, 1), (99, 1, 1), (7, 1, 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, part int").repartition(4)
    said = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert sorted(map(tuple, filter_audit.audit(docs, said).select(*AUDIT).collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(empty, said).count() == 0
    none = filter_audit.audit(docs, said.limit(0)).toPandas()
    assert none.good_lost.sum() == none.toxic_lost.sum() == 0 and none.removed.sum() > 0


def test_cells_come_back_from_parity_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(32), r.randint(-3, 10**12), r.randint(0, 1), r.randint(0, 1)) for _ in range(300)]
    cells = filter_audit.mask_cells(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, n long, good int, toxic int"))).collect()
    for x in cells:
        for c, take in (("all", lambda y: 1), ("good", lambda y: y[3]), ("toxic", lambda y: y[4])):
            assert x[c] == [sum(y[2] for y in rows if y[0] == x.part and y[1] == m and take(y)) for m in range(32)]


# --- 13


def brute_repeats(rows, width=20):
    """For each row: words, removed, kept; documents in the order of (key, with nulls last)."""
    seen, out = set(), {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for none, i, t in order:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                gone |= set(range(k, k + width))
            seen.add(g)
        out[None if none else i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return collections.Counter((i, *out[i, t or ""]) for i, t in rows)


def repeats(df, **options):
    got = substrings.remove_repeats(df, **options).toPandas()
    return collections.Counter((None if pd.isna(i) else int(i), n, m, k) for i, n, m, k in zip(got.doc_id, got.n_words, got.n_removed, got["_kept" if "_kept" in got else "kept"], strict=True))


@pytest.mark.parametrize("period", sorted(substrings.COVERS))
def test_covers(period):
    """For any two places some shift below the period takes both into the cover."""
    cover = substrings.COVERS[period]
    assert all(any((a + s) % period in cover and (b + s) % period in cover for s in range(period)) for a in range(period) for b in range(period))


@pytest.mark.parametrize(("period", "width"), [(3, 6), (7, 20), (7, 8), (13, 20)])
def test_repeats_equal_brute_force(spark, monkeypatch, period, width):
    """Passages copied to any offset, changed copies, loops; groups small, so that places meet in and between them."""
    monkeypatch.setattr(substrings, "GROUP_WORDS", 300)
    monkeypatch.setattr(substrings, "BYTES_PER_DEAL", 4_000)
    r = random.Random(period * 100 + width)
    rows = []
    for i in range(90):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.choice([0, 5, 30, 80]))]
        for _ in range(r.randint(0, 2)):
            if rows:
                o = words(r.choice(rows)[1])
                a = r.randint(0, max(0, len(o) - 1))
                part = o[a : a + r.randint(width - 2, 2 * width)]
                at = r.randint(0, len(w))
                w[at:at] = part * r.choice([1, 1, 2])
        rows.append((r.randint(-(1 << 62), 1 << 62) if i % 3 else i, " ".join(w)))
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=width, period=period) == brute_repeats(rows, width)


def test_one_passage_in_all_rows(spark, monkeypatch):
    """A hot passage and exact copies: what meets in a deal grows with the groups of rows, not with the rows."""
    monkeypatch.setattr(substrings, "GROUP_WORDS", 2_000)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)] + [(1000 + i, passage) for i in range(100)]
    sent = []
    meet = substrings._meet
    monkeypatch.setattr(substrings, "_meet", lambda packed, *a: (sent.append(packed.where("hashes is not null").selectExpr("sum(length(own)) / 2 n").first().n), meet(packed, *a))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert repeats(docs) == brute_repeats(rows)
    assert sum(sent) < 300 * 8 + 60 * 2 * 20  # of about 25,000 anchors and 16,000 windows


def test_repeats_of_hard_rows(hard, empty):
    rows = HARD
    seven = {t for i, t in rows if i == 7}
    got = repeats(hard)
    want = brute_repeats(rows)
    assert {k for k in got if k[0] != 7} == {k for k in want if k[0] != 7} and sum(got.values()) == len(rows) and len(seven) == 2
    out = substrings.remove_repeats(hard).toPandas()
    assert list(out.columns) == [*hard.columns, "n_words", "n_removed", "_kept"] and (out["kept"] == "clash").all()
    twice = out[(out.doc_id == 7) & out.text.str.startswith("A ")]
    assert len(twice) == 2 and twice.n_removed.nunique() == 1
    assert substrings.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(hard, width=5, period=7)


def test_window_hashes_stand_for_their_words():
    from tilewright.llm.vectors import window_hashes

    h = np.random.default_rng(1).integers(0, 5, 4000).astype(np.uint64)
    for width in (1, 2, 3, 8, 14, 20):
        g = window_hashes(h, width)
        seen = {}
        assert len(g) == len(h) - width + 1 and all(seen.setdefault(tuple(h[i : i + width].tolist()), x) == x for i, x in enumerate(g.tolist())) and len(set(seen.values())) == len(seen)
    assert len(window_hashes(h[:3], 4)) == 0
