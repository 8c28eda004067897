"""Order-dependent operators and searches against brute force, on random rows."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewright.functions import sequence
from tilewright.operators import search, selection, windows


@pytest.mark.parametrize("seed", range(3))
def test_remove_overlap_sites(spark, seed):
    r = random.Random(seed)
    data = [(r.randint(0, 1), a := r.randint(0, 80), a + r.randint(3, 9), f"o{r.randint(0, 12)}", i) for i in range(60)]
    got = {x["row_id"] for x in selection.remove_overlap_sites(spark.createDataFrame(data, "g int, s int, e int, o string, row_id long"), ["g"], "s", "e", ["o"], 2).collect()}
    want = set()
    for g in (0, 1):
        rows = sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[4]))
        taken, seen = [], set()
        for _, _, _, o, i in rows:
            if o in seen:
                continue
            seen.add(o)
            own = {(a, b) for _, a, b, p, _ in rows if p == o}
            if all(b + 2 < c or d + 2 < a for a, b in own for c, d in taken):
                want.add(i)
                taken += own
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_remove_overlap_prefers(spark, seed):
    r = random.Random(seed)
    data = [(a := r.randint(0, 60), a + r.randint(2, 6), r.choice([None, 1.0, 2.0]), i) for i in range(50)]
    got = {x["row_id"] for x in selection.remove_overlap(spark.createDataFrame(data, "s int, e int, p double, row_id long").withColumn("g", F.lit(1)), ["g"], "s", "e", 1, "p").collect()}
    want, last = set(), None
    for a, b, _, i in sorted(data, key=lambda x: (x[0], float("inf") if x[2] is None else x[2], x[3])):
        if last is None or a > last + 1:
            want.add(i)
            last = b
    assert got == want


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_off_target_pool(spark, limit):
    r = random.Random(limit)
    data = [(r.choice("ab"), sorted({f"g{r.randint(0, 5)}" for _ in range(r.randint(0, 3))}), r.randint(0, 4), i) for i in range(40)]
    got = {x["row_id"] for x in selection.off_target_pool(spark.createDataFrame(data, "t string, genes array<string>, score int, row_id long"), "t", "genes", limit, ["score"]).collect()}
    want, used = set(), Counter()
    for t, genes, _, i in sorted(data, key=lambda x: (x[2], x[3])):
        if all(used[t, g] < limit for g in genes):
            want.add(i)
            used.update((t, g) for g in genes)
    assert got == want


def test_avoid_peaks(spark):
    r = random.Random(3)
    data = [(1, i, [(r.choice("xy"), a := r.randint(0, 400), a + 10) for _ in range(r.randint(1, 3))]) for i in range(50)]
    regions = [(1, "x", 100, 300)]
    got = {x["row_id"]: (x["on_target"], x["off_target"]) for x in selection.avoid_peaks(spark.createDataFrame(data, "t int, row_id long, sites array<struct<name:string,start:long,end:long>>"), "t", spark.createDataFrame(regions, "t int, name string, start long, end long"), 0.05, (-20, 20)).collect()}
    on = lambda s: s[0] == "x" and s[1] < 300 and 100 < s[2]
    kept, want = [], {}
    for _, i, sites in sorted(data, key=lambda x: (-sum(map(on, x[2])), x[1])):
        own, ok = [], True
        for s in sites:
            met = lambda a, b, s=s: len({(p, q) for p, q in [*kept, *own] if p[0] == s[0] and p[1] < b and a < p[2]})  # noqa: E731, B023
            if (on(s) and met(s[1], s[2])) or (not on(s) and met(s[1] - 20, s[2] + 20) / 40 >= 0.05):
                ok = False
                break
            own.append((s, i))
        if ok:
            kept += own
            if n := sum(map(on, sites)):
                want[i] = (n, len(sites) - n)
    assert got == want


def test_compositions_are_all():
    bounds = {"a": (1, 3), "b": (0, 2), "c": (2, 4)}
    want = [s for s in itertools.product(range(1, 4), range(3), range(2, 5)) if 5 <= sum(s) <= 6]
    assert windows.compositions(bounds, 5, 6) == want
    with pytest.raises(ValueError):
        windows.compositions(bounds, 20, 21)


@pytest.mark.parametrize("strand", ["sense", "both"])
def test_mismatch_sites(spark, strand):
    r = random.Random(9)
    recs = [(f"g{i % 3}_t{i}", "".join(r.choice("ACGT") for _ in range(60))) for i in range(8)]
    qs = []
    for _ in range(10):
        s = list(r.choice(recs)[1][(a := r.randint(0, 40)) : a + r.randint(12, 16)])
        for _ in range(r.randint(0, 3)):
            s[r.randrange(len(s))] = r.choice("ACGT")
        qs.append(("".join(s),))
    got = {tuple(x) for x in search.mismatch_sites(spark.createDataFrame(qs, "q string"), spark.createDataFrame(recs, "rec string, seq string"), "q", "rec", "seq", 2, strand).collect()}
    want = set()
    for (q,) in qs:
        for mark, w in (("+", q), ("-", q[::-1].translate(str.maketrans("ACGT", "TGCA"))))[: 1 if strand == "sense" else 2]:
            for name, seq in recs:
                for i in range(len(seq) - len(w) + 1):
                    if (n := sum(a != b for a, b in zip(w, seq[i:], strict=False))) <= 2:
                        want.add((q, mark, name, i, n))
    assert got == want


def test_windows_of_short_sequences(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "AC"), ("c", None), ("d", "")], "k string, s string")
    assert windows.sliding_windows(df, "s", 3).count() == 2
    with pytest.raises(ValueError):
        windows.window_structs(F.col("s"), 0)


def test_conditions(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    assert df.where(selection.condition_column(df, "x >= 1 & y < 3")).count() == 2
    with pytest.raises(ValueError):
        selection.parse_condition("x <= 1e-5")
    with pytest.raises(ValueError):
        selection.condition_column(df, "y < 3", strict=True)


def test_even_spacing_of_one_and_none(spark):
    df = spark.range(10).select(F.lit("a").alias("t"), F.col("id").alias("p"), F.col("id").alias("row_id"))
    assert [x["p"] for x in selection.even_ranks(df, "t", "p", F.lit(1)).collect()] == [0]
    assert sorted(x["p"] for x in selection.even_ranks(df, "t", "p", F.lit(4)).collect()) == [0, 3, 6, 9]
    assert selection.even_ranks(df, "t", "p", F.lit(None).cast("int")).count() == 10


def test_packed_bases_differ_as_their_letters(spark):
    r = random.Random(3)
    rows = []
    for n in (1, 2, 13, 30, 31, 32, 60):
        for _ in range(8):
            a = "".join(r.choices("ACGT", k=n))
            rows.append((a, "".join(r.choice("ACGT") if r.random() < 0.4 else c for c in a)))
    rows += [("ACGN", "ACGT"), ("acgt", "ACGT"), ("", "")]
    a, b = sequence.packed_bases("a"), sequence.packed_bases("b")
    for x in spark.createDataFrame(rows, "a string, b string").select("a", "b", sequence.packed_distance(a, b).alias("fast"), sequence.hamming("a", "b").alias("slow")).collect():
        assert x.slow == sum(c != d for c, d in zip(x.a, x.b, strict=True))
        assert x.fast == (x.slow if 0 < len(x.a) <= 31 and set(x.a) <= set("ACGT") else None)


def test_sites_of_very_short_queries(spark):
    """Words no longer than the mismatches allowed fit everywhere; the others are found by their pieces."""
    record = "ACGTTGCAAGCN"
    words = ["A", "GT", "TGC", "CAAG", "GGGGGG"]
    got = search.mismatch_sites(spark.createDataFrame([(w,) for w in words], "q string"), spark.createDataFrame([("r", record)], "record string, seq string"), "q", "record", "seq", 2).collect()
    want = {(w, i, d) for w in words for i in range(len(record) - len(w) + 1) if (d := sum(x != y for x, y in zip(w, record[i:], strict=False))) <= 2}
    assert {(x["query"], x["start0"], x["mismatches"]) for x in got} == want and len(got) == len(want)


def test_transcript_values(spark):
    hits = spark.createDataFrame([("q", "G1_T1", 0), ("q", "G1_T1", 5), ("q", "G1_T2.1", 0), ("q", "G2_T3", 1), ("p", "G2_T4.9", 1), ("p", "G3_N_5", 0)], "query string, record string, start0 int")
    table = spark.createDataFrame([(" T1.4 ", 2.0), ("T1.4", 3.0), ("T2.1", 1.5), ("T2.2", 9.0), ("T3.1", 1.0), ("T3.2", 1.0), ("T4", 0.0), ("", 7.0), (None, 1.0), ("N_5", float("nan"))], "id string, value double")
    got = {(x.query, x.gene): (x.value, x.missing, [tuple(t) for t in x.hit_transcripts]) for x in search.transcript_values(hits, table).collect()}
    assert got == {
        ("q", "G1"): (4.5, [], [("T1", 3.0), ("T2.1", 1.5)]),  # without version only one id fits T1; T2.1 is listed itself
        ("q", "G2"): (None, ["T3"], [("T3", None)]),  # two ids without version
        ("p", "G2"): (0.0, [], [("T4.9", 0.0)]),
        ("p", "G3"): (None, ["N_5"], [("N_5", None)]),
    }
    assert search.transcript_values(hits.limit(0), table).count() == 0
    assert search.transcript_values(hits, table.limit(0)).where("value is not null").count() == 0


def test_pool_of_one_large_target(spark):
    """Rows of one target over many batches, genes null and repeated, against a plain pass in rank order."""
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", None]), None if i % 11 == 0 else [r.choice("vwxyz") for _ in range(r.randrange(4))], r.randrange(50), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "t string, genes array<string>, score int, row_id long")
    got = {x.row_id for x in selection.off_target_pool(df, "t", "genes", 40, ["score"]).collect()}
    used, want = {}, set()
    for t, genes, _, i in sorted(rows, key=lambda x: (x[2], x[3])):
        if all(used.get((t, g), 0) < 40 for g in set(genes or ())):
            want.add(i)
            for g in set(genes or ()):
                used[t, g] = used.get((t, g), 0) + 1
    assert got == want and len(got) < 3_000
