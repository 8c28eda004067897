"""The seed index against a comparison of every place."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import search, seeds

FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def brute(queries, records, most, strand):
    out = set()
    for q in queries:
        for mark, w in (("+", q), ("-", q[::-1].translate(FLIP))):
            if mark in {"sense": "+", "antisense": "-", "both": "+-"}[strand]:
                for name, seq in records:
                    for i in range(len(seq) - len(w) + 1):
                        if (d := sum(a != b for a, b in zip(w, seq[i : i + len(w)], strict=True))) <= most:
                            out.add((q, mark, name, i, d))
    return out


@pytest.fixture(scope="module")
def made():
    r = random.Random(5)
    records = [(f"r{i}", "".join(r.choices("ACGT", k=n))) for i, n in enumerate((9, 10, 31, 60, 200, 700))]
    records += [("gaps", records[4][1][:40] + "N" * 30 + records[4][1][50:90] + "aNc" + records[5][1][:50]), ("low", "A" * 300), ("none", ""), ("one", "C")]
    whole = [(n, s) for n, s in records if len(s) >= 60]
    queries = set()
    for size in (4, 10, 11, 19, 20, 31, 32, 45, 60):
        for _ in range(6):
            _, s = r.choice(whole)
            at = r.randrange(len(s) - size + 1)
            w = list(s[at : at + size])
            for _ in range(r.randrange(4)):
                w[r.randrange(size)] = r.choice("ACGT")
            queries.add("".join(w) if r.random() < 0.6 else "".join(w)[::-1].translate(FLIP))
    return sorted(queries), records


@pytest.mark.parametrize(("strand", "most"), [("sense", 0), ("both", 2), ("antisense", 3)])
@pytest.mark.parametrize("split_above", [3, 100_000])
def test_index_finds_what_every_place_shows(spark, made, monkeypatch, strand, most, split_above):
    """Short and long, other letters, over several chunks, with salted seeds and without."""
    queries, records = made
    monkeypatch.setattr(seeds, "CHUNK", 128)
    monkeypatch.setattr(seeds, "REACH", 100)
    index = seeds.write_index(spark.createDataFrame([*records, ("null", None)], "name string, s string"), "name", "s", 8 if most == 3 else 10, 3, split_above)
    assert (index.hot.count() > 0) == (split_above == 3)
    got = [tuple(x) for x in seeds.indexed_sites(spark.createDataFrame([(q,) for q in [*queries, None, queries[0]]], "q string"), index, "q", most, strand).collect()]
    want = brute(queries, records, most, strand)
    assert len(got) == len(set(got)) and set(got) == want and len({q for q, *_ in want}) > 5
    seeds.drop(index)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(index.name)]


def test_index_stays_in_place(spark, made):
    """A sorted join reads the bucketed places without moving them; two attributes share them."""
    queries, records = made
    index = seeds.write_index(spark.createDataFrame(records, "name string, s string"), "name", "s", 10, 4)
    q = spark.createDataFrame([(x,) for x in queries if 10 <= len(x) <= 31 and "N" not in x and x.isupper()], "q string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = seeds.indexed_sites(q, index, "q", 2, "both")
        plan = hits._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "odd_here" in line)
        above = "\n".join(plan[:scan]).rpartition("SortMergeJoin [seed")[2]
        assert "Bucketed: true" in plan[scan] and above
        mine = above[above.rfind("+- Sort [seed") :]
        assert "Exchange" not in mine, "\n".join(plan)
        genes = search.fewest_mismatches(hits)
        assert genes.count() == len({(a, c.split("_")[0]) for a, _, c, _, _ in brute([x.q for x in q.collect()], records, 2, "both")})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_buckets_follow_the_bases(spark, made, monkeypatch):
    """Larger records make more buckets, not larger ones; queries are dealt to as many, and find the same."""
    queries, records = made
    monkeypatch.setattr(seeds, "BUCKET_PLACES", 200, raising=False)
    index = seeds.write_index(spark.createDataFrame([*records, ("null", None)], "name string, s string"), "name", "s", 10)
    want = -(-sum(len(s) for _, s in records) // 200)
    assert want > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {x.data_type for x in spark.sql(f"DESCRIBE EXTENDED {index.name}_places").collect() if x.col_name == "Num Buckets"} == {str(want)}
    hits = seeds.indexed_sites(spark.createDataFrame([(q,) for q in queries], "q string"), index, "q", 2, "both")
    assert {tuple(x) for x in hits.collect()} == brute(queries, records, 2, "both")
    assert "hashpartitioning(seed" in (plan := hits._jdf.queryExecution().executedPlan().toString()) and f", {want})" in plan
    seeds.drop(index)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "name string, s string")
    index = seeds.write_index(empty, "name", "s")
    assert seeds.indexed_sites(spark.createDataFrame([("ACGTACGTACGT",)], "q string"), index, "q", 1).count() == 0
    some = seeds.write_index(spark.createDataFrame([("a", "ACGTACGTACGT")], "name string, s string"), "name", "s")
    assert seeds.indexed_sites(empty.select(F.col("s").alias("q")), some, "q", 1).count() == 0
    with pytest.raises(ValueError, match="4 to 15"):
        seeds.write_index(empty, "name", "s", 3)


def test_substitutions():
    xors, counts = seeds.substitutions(5, 2)
    assert counts == [1, 16, 106] and len(set(xors)) == 106 and max(xors) < 4**5
