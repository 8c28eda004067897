"""Gapped local alignment against a full dynamic programme."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import alignment as A


def plain(q, r):
    """The best local score over all places, by the three-matrix recurrence, and the sites that have it: (score, start, end)."""
    low = (-(10**9), 0)
    h = [[low] * (len(r) + 1) for _ in range(len(q) + 1)]
    e = [[low] * (len(r) + 1) for _ in range(len(q) + 1)]
    f = [[low] * (len(r) + 1) for _ in range(len(q) + 1)]
    best = (0, 0, 0)
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            s = -1 if "N" in (q[i - 1], r[j - 1]) else 2 if q[i - 1] == r[j - 1] else -6
            e[i][j] = max((h[i - 1][j][0] - 8, h[i - 1][j][1]), (e[i - 1][j][0] - 3, e[i - 1][j][1]))
            f[i][j] = max((h[i][j - 1][0] - 8, h[i][j - 1][1]), (f[i][j - 1][0] - 3, f[i][j - 1][1]))
            d = max(h[i - 1][j - 1], (0, -(j - 1)))
            h[i][j] = max((d[0] + s, d[1]), e[i][j], f[i][j])
            if h[i][j][0] > best[0] or (h[i][j][0] == best[0] and (-h[i][j][1], j) < (best[1], best[2])):
                best = (h[i][j][0], -h[i][j][1], j)
    return best


def changed(r, word, edits):
    for _ in range(edits):
        i = r.randrange(1, len(word) - 1)
        word = r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice("ACGT") + word[i:], word[:i] + r.choice("ACGTN") + word[i + 1 :]])
    return word


def test_extension_equals_the_full_programme():
    r = random.Random(1)
    checked = 0
    for n in (22, 27, 32, 45):
        qs, rs = [], []
        for _ in range(500):
            q = "".join(r.choice("ACGT") for _ in range(n))
            there = changed(r, q, r.randrange(4))
            there = "-" * 12 + ("".join(r.choice("ACGT") for _ in range(r.randrange(8))) + there).ljust(n + 20, r.choice("ACGT-"))[: n + 20]
            qs.append(q)
            rs.append(there)
        score, start, end = A.extend(*(np.array([list(x.encode()) for x in side], np.uint8) for side in (qs, rs)))
        for q, there, *got in zip(qs, rs, score.tolist(), start.tolist(), end.tolist(), strict=True):
            want = plain(q, there.strip("-"))
            if want[0] >= 20 + 8 * math.log(n):
                assert (got[0], got[1] - 12, got[2] - 12) == want, (q, there)
                checked += 1
    assert checked > 1000


def test_all_sites_are_found(spark):
    r = random.Random(2)
    records = {f"g{i}_t": "".join(r.choice("ACGT") for _ in range(r.choice([5, 60, 150, 560]))) for i in range(9)}
    queries = set()
    for _ in range(30):
        text = r.choice([x for x in records.values() if len(x) > 50])
        at = r.randrange(len(text) - 36)
        queries.add(changed(r, text[at : at + r.choice([24, 30, 34])], r.randrange(4)))
    complement = str.maketrans("ACGTN", "TGCAN")
    q = spark.createDataFrame([(x,) for x in queries] + [(None,), ("",), ("ACGT",)], "q string")
    t = spark.createDataFrame([*records.items(), ("none_t", None), ("empty_t", "")], "name string, s string")
    got = {(x.query, x.strand, x.record): (x.score, x.start0, x.end0) for x in A.local_sites(q, t, "q", "name", "s", "both", shortest=1, most=None).orderBy("score", F.desc("start0"), F.desc("end0")).collect()}
    want = {}
    for x in queries:
        for sign, word in (("+", x), ("-", x[::-1].translate(complement))):
            for name, text in records.items():
                best = plain(word, text)
                if best[0] >= 20 + 8 * math.log(len(word)):
                    want[x, sign, name] = best
    assert got == want and len(want) > 10


def test_a_cell_beyond_both_ends_and_over_chunks(spark):
    r = random.Random(3)
    long = "".join(r.choice("ACGT") for _ in range(3000))
    cuts = [0, 490, 500, 511, 512, 1010, 1024, 2968]
    q = spark.createDataFrame([(long[a : a + 14] + long[a + 15 : a + 32],) for a in cuts], "q string")
    got = {(x.start0, x.end0, x.score) for x in A.local_sites(q, spark.createDataFrame([(7, long)], "id long, s string"), "q", "id", "s").collect()}
    assert got == {(a, a + 32, 54) for a in cuts}


def test_best_sites_of_a_repeat(spark):
    """One record of one base: many places of equal score; the first by start are kept, whatever the number."""
    q = spark.createDataFrame([("A" * 30,)], "q string")
    t = spark.createDataFrame([("r_t", "A" * 2000)], "name string, s string")
    got = A.local_sites(q, t, "q", "name", "s", most=5).collect()
    assert len(got) == 5 and {x.score for x in got} == {60} and all(x.end0 - x.start0 == 30 for x in got)


def test_short_queries_and_empty_tables(spark):
    t = spark.createDataFrame([("r_t", "ACGTACGTACGTACGTACGTA")], "name string, s string")
    short = spark.createDataFrame([("ACGTACGTACGTACGTACGTA",)], "q string")
    assert A.local_sites(short, t, "q", "name", "s").count() == 0  # a whole match of 21 bases scores too little
    assert A.local_sites(short.limit(0), t, "q", "name", "s").count() == 0
    assert A.local_sites(short, t.limit(0), "q", "name", "s").count() == 0


def test_regions_without_the_words_of_a_site_are_not_extended():
    """Rows with up to six changes, gaps and N: none that reaches the score is left out, and of chance regions nearly all are."""
    rng, bases = np.random.default_rng(3), np.frombuffer(b"ACGT", np.uint8)
    for n in (18, 31, 41, 60):
        least = A.LEAST + A.LEAST_LOG * np.log(n)
        reach = A.WIDTH - 1 + 2 * max(int((2 * n - 5 - least) // 3), 0) + n
        q, r = rng.choice(bases, (2000, n)), rng.choice(bases, (2000, reach))
        for i in range(1000):
            x, at = list(q[i]), int(rng.integers(0, reach - n + 1))
            for _ in range(rng.integers(0, 7)):
                j = int(rng.integers(0, len(x)))
                x[j : j + 1] = [[int(rng.choice(bases))], [], [x[j], int(rng.choice(bases))], [ord("N")]][rng.integers(0, 4 if i % 4 == 0 else 3)]
            x = np.array(x[: reach - at], np.uint8)
            r[i, at : at + len(x)] = x
        may = A.may_reach(q, r)
        score, _, _ = A.extend(q, r)
        assert not ((score >= least) & ~may).any(), n
        assert n == 18 or (score[:1000] >= least).sum() > 100
        if n in (31, 41):
            assert may[1000:].mean() < 0.01


def test_long_sure_runs_are_looked_up_by_few_long_seeds(spark):
    """A site of 31 bases holds a run of 14, so every second word of 13 will do; seeds travel as numbers, queries once a row."""
    row = spark.range(1).select(*[A.sure_run(F.lit(n)).alias(f"a{n}") for n in (21, 24, 31, 41)]).first()
    assert (row.a21, row.a24, row.a31, row.a41) == (None, 23, 14, 8)
    r = random.Random(5)
    text = "".join(r.choice("ACGT") for _ in range(64))
    cut = spark.createDataFrame([(text[:14] + text[15:32],), (text[20:34] + "ACGT"["CGTA".index(text[34])] + text[35:51],)], "q string")
    df = A.local_sites(cut, spark.createDataFrame([("a_1", text)], "name string, s string"), "q", "name", "s")
    seeds = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(seed#" in x]
    assert len(seeds) == 2 and all("L, " in x.partition("seed#")[2][:10] for x in seeds)
    assert {(x.start0, x.end0, x.score) for x in df.collect()} == {(0, 32, 54), (20, 51, 54)}
