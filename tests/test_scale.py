"""Steps whose cost must grow with their input: what is dealt over tasks, and what must not pass the driver."""

import math
import random

from pyspark.sql import functions as F

from tilewright.operators import alignment, search, seeds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _keyed_by(plan, kind, key):
    return [x for x in plan.splitlines() if kind in x and key in x]


def _inputs(spark):
    draw = random.Random(5)
    base = "".join(draw.choice("ACGT") for _ in range(64))
    return spark.createDataFrame([(base[i : i + 31],) for i in range(9)], "q string"), spark.createDataFrame([("g_1", base)], "record string, seq string")


def test_seeds_are_not_broadcast(spark):
    """Exploded seeds are many times their table's bytes, which is what a plan's estimate sees; the driver must not hold them."""
    q, r = _inputs(spark)
    found = {
        "mismatches": search.mismatch_sites(q, r, "q", "record", "seq", 2),
        "heuristic": search.heuristic_sites(q, r, "q", "record", "seq"),
        "gapped": alignment.local_sites(q, r, "q", "record", "seq"),
        "indexed": seeds.indexed_sites(q, seeds.write_index(r, "record", "seq", 9), "q", 2),
    }
    for name, df in found.items():
        plan = _plan(df)
        assert not [x for x in _keyed_by(plan, "BroadcastHashJoin", "[seed") if "LeftOuter" not in x] and not _keyed_by(plan, "BroadcastHashJoin [frame", "seed"), name
        assert _keyed_by(plan, "SortMergeJoin", "seed"), name
        assert df.count() >= 9, name


def test_mismatch_frames_hold_every_site(spark, as_rows):
    """Lengths below, at and above the frames; blanks in both; a record of several chunks; no to three substitutions."""
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    recs = [("a_1", word(1300)), ("b_1", word(40) + "NNNN" + word(30)), ("c_1", word(12)), ("d_1", "")]
    queries = set()
    for n in (2, 4, 7, 12, 15, 19, 20, 23, 24, 31, 32, 45):
        for _, text in recs[:2]:
            for at in (0, 505, len(text) - n):
                at = min(at, len(text) - n)
                bases = list(text[at : at + n])
                for i in draw.sample(range(n), min(n, 3)):
                    bases[i] = draw.choice("ACGT")
                queries.add("".join(bases))
    queries.add("ACN" + word(15))
    for m in (0, 1, 2, 3):
        want = {(q, "+", r, i, sum(a != b for a, b in zip(q, s[i:], strict=False))) for q in queries if len(q) > m for r, s in recs for i in range(len(s) - len(q) + 1)}
        want = {x for x in want if x[4] <= m}
        got = search.mismatch_sites(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame(recs, "r string, seq string"), "q", "r", "seq", m)
        got = got.where(F.length("query") > m).collect()
        assert len(got) == len(set(got)) and {tuple(x) for x in got} == want


def test_a_pair_is_selective(spark):
    """Queries of 15 bases or more meet a place by 10 bases at least, where a piece alone had six of 18."""
    for m, low in ((1, 10), (2, 15), (3, 20)):
        for n in range(low, 21):
            assert all(sum(size for _, size in pieces) >= 10 for _, pieces in search.frames(m, n))


def test_long_rows_are_dealt(spark, tables):
    """A table of one small file would leave this work to one task; a number of tasks that is given is not put together."""
    from tilewright.catalog import base, sequences  # noqa: F401

    for name in ("f11_fold_score", "f13_blocks", "f11_f13_stem_score", "f12_self_match"):
        assert "REPARTITION_BY_NUM" in _plan(base.QUERIES[name](spark, tables)), name


def test_a_gapped_site_needs_several_seeds(spark):
    """A chance seed of 10 bases is no reason to extend: a site of 31 bases holds three."""
    row = spark.range(1).select(*[alignment.least_seeds(F.lit(n), F.lit(k)).alias(f"a{n}") for n, k in ((31, 10), (41, 10), (24, 22))]).first()
    assert (row.a31, row.a41, row.a24) == (3, 1, 2)


def test_heuristic_sites_move_the_bases_they_compare(spark):
    """Beyond the seeds' join no record travels whole; scores are those of a plain pass, also where a record ends early."""
    draw = random.Random(7)
    base = "".join(draw.choice("ACGT") for _ in range(400))
    changed = [base[a : a + n] for a, n in ((0, 32), (100, 45), (368, 32))] + [base[50:66] + "A" + base[67:90], base[380:] + "ACGTACGTACGT" * 2]
    recs = [("a_1", base), ("b_1", base[40:130] + "NN" + base[200:260]), ("c_1", base[385:])]
    df = search.heuristic_sites(spark.createDataFrame([(x,) for x in changed], "q string"), spark.createDataFrame(recs, "r string, seq string"), "q", "r", "seq")
    want = set()
    for q in changed:
        for name, text in recs:
            ats = {s - i for i in range(0, len(q) - 11, 4) for s in range(len(text) - 11) if q[i : i + 12] == text[s : s + 12]}
            for at in (x for x in ats if x >= 0):
                now = best = 0
                for i, x in enumerate(q):
                    now = max(0, now + (2 if text[at + i : at + i + 1] == x else -6))
                    best = max(best, now)
                if best >= 20 + 8 * math.log(len(q)):
                    want.add((q, name, at, best))
    assert {tuple(x) for x in df.collect()} == want and len(want) >= 5
    dealt = [x for x in _plan(df).splitlines() if "Exchange hashpartitioning(query" in x]
    assert dealt and not [x for x in dealt if "seq#" in x]


def test_shared_short_words_are_counted_by_block(spark, monkeypatch):
    """Several blocks on both sides, repeated and null names, other letters, texts without a word; no join by words."""
    monkeypatch.setattr(search, "BLOCK", 40)
    monkeypatch.setattr(search, "FACING", 25)
    draw = random.Random(3)
    text = lambda: "".join(draw.choice("ACGTN") for _ in range(draw.randrange(1, 24)))
    ts = [(i % 17, text()) for i in range(30)] + [(None, "ACGTACGT"), (50, None), (51, "NNNN")]
    rs = [(f"r_{i % 25}", text()) for i in range(40)] + [(None, "ACGTACGT"), ("none", "A")]

    def words(rows):
        out = {}
        for name, s in rows:
            out.setdefault(name, set()).update(s[i : i + 3] for i in range(len(s or "") - 2) if "N" not in s[i : i + 3])
        return out

    a, b = words(ts), words(rs)
    for least in (1, 3):
        want = {(t, r, round(len(x & y) / len(x), 9)) for t, x in a.items() if t is not None and x for r, y in b.items() if len(x & y) >= least}
        got = search.shared_kmers(spark.createDataFrame(ts, "t long, s string"), spark.createDataFrame(rs, "r string, s string"), "t", "s", "r", "s", 3, least=least)
        assert "Join" not in _plan(got)
        rows = got.collect()
        assert {(x.target, x.record, round(x.share, 9)) for x in rows} == want and len(rows) == len(want)
        long = search.shared_kmers(spark.createDataFrame(ts, "t long, s string"), spark.createDataFrame(rs, "r string, s string"), "t", "s", "r", "s", 9, least=least).collect()
        assert all(x.share > 0 for x in long)
    empty = search.shared_kmers(spark.createDataFrame([], "t long, s string"), spark.createDataFrame(rs, "r string, s string"), "t", "s", "r", "s", 3)
    assert empty.count() == 0


def test_lists_on_their_way_to_python_are_not_null(spark):
    """A null list costs as much as the rows of its batch before it; oligos with one site must come with an empty list."""
    from tilewright.operators import selection

    rows = [("t", i, 10 * i + 1, 10 * i + 8, "AAA" if i in (1, 4) else f"o{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "g string, row_id long, s long, e long, o string")
    seen = []
    plain = type(df).mapInArrow

    def watched(self, *given, **more):
        seen.append(self.where("sites_ is null").count())
        return plain(self, *given, **more)

    type(df).mapInArrow = watched
    try:
        got = selection.remove_overlap_sites(df, ["g"], "s", "e", ["o"], report=True).orderBy("s").collect()
    finally:
        type(df).mapInArrow = plain
    assert seen == [0]
    assert [(x.row_id, x.n_sites, x.oligo_sites) for x in got] == [(0, 1, "1-8"), (1, 2, "11-18;41-48"), (2, 1, "21-28"), (3, 1, "31-38"), (5, 1, "51-58")]


def test_a_design_is_made_once_before_it_is_sorted(spark):
    """A global sort samples what it sorts, so the steps before it would run twice."""
    from tilewright.catalog import relations
    from tilewright.plans import protocol

    out = protocol.run(relations.PROTOCOL, spark.createDataFrame([("a", "ACGTTGCAAGCTTCGAGGCTAACGTTGACCAT")], "target string, seq string"))
    plan = _plan(out)
    assert plan.count("Exchange rangepartitioning") == 1 and "MapInArrow" not in plan and "Window" not in plan
    assert out.count() > 0


def test_spliced_sequences_are_dealt_before_their_windows(spark):
    """Sequences are few bytes, which adaptive execution would give to one task with all work on their windows."""
    from tilewright.plans import extraction

    whole = spark.createDataFrame([("a", "t", "ACGTACGT", [("x", 0, 8)])], "target string, transcript_id string, seq string, parts array<struct<name:string,a:int,b:int>>")
    w = extraction._spliced_windows(whole, 4, 4, 2)
    assert [x for x in _plan(w).splitlines() if "hashpartitioning(target" in x and "REPARTITION_BY_NUM" in x]
    assert sorted(x.target_region for x in w.collect()) == ["ACGT", "ACGT", "GTAC"]


def test_tasks_follow_the_rows(spark, tables, monkeypatch, as_rows):
    """Line items of a task stay as many when the table grows; they are not sorted by key before they are dealt."""
    from tilewright import session
    from tilewright.catalog import base, relations

    whole = as_rows(base.QUERIES["j12_w11_result_check"](spark, tables).toPandas())
    monkeypatch.setattr(session, "ROWS", 500, raising=False)
    n = -(-base.Tables(spark, tables).lineitem.count() // 500)
    df = base.QUERIES["j12_w11_result_check"](spark, tables)
    plan = _plan(df).splitlines()
    assert n > 4 and len([x for x in plan if f", {n}), REPARTITION_BY_NUM" in x]) == 2 and not [x for x in plan if "ENSURE_REQUIREMENTS" in x]
    assert as_rows(df.toPandas()) == whole
    lines = _plan(relations.days(base.Tables(spark, tables))).splitlines()
    first = next(i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x)
    assert [x for x in lines[:first] if "Aggregate" in x] and not [x for x in lines[first:] if "Aggregate" in x or "Sort" in x]


def test_dealt_rows_stay_dealt_above_a_shuffle_of_the_same_keys(spark):
    """Spark lets a shuffle below stand for an equal one above it, and puts the few bytes of that one together again."""
    from tilewright import session

    few = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").groupBy("k").agg(F.sum("n").alias("n"))
    assert [x for x in _plan(session.spread(few, "k")).splitlines() if "hashpartitioning(k" in x and "REPARTITION_BY_NUM" in x]


def test_temperatures_are_made_once_a_row(spark):
    """A filter between two bounds reads the column that was made, and does not make it again."""
    from tilewright.functions import thermo

    df = spark.createDataFrame([("ACGTACGTACGTTGCA",), ("AC",), (None,)], "s string")
    for tm in (thermo.tm_primer("s"), thermo.tm_padlock("s"), thermo.tm_miner("s"), thermo.tm_merfish("s")):
        plan = _plan(df.withColumn("tm", tm).where("tm >= 1 and tm <= 90"))
        assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan and "aggregate(" not in plan


def test_queries_and_genes_hit_are_not_broadcast(spark):
    """A plan takes them for as few bytes as the small table that they are made of, and the driver would hold all of them."""
    from tilewright.plans import similarity

    q, r = _inputs(spark)
    df = q.withColumn("target", F.lit("g"))
    genes = spark.createDataFrame([("g", "G", "protein_coding")], "gene string, label string, biotype string")
    out = similarity.add(df, "hits", {"type": "mapped_genes", "strand": "sense"}, "q", {"records": r.withColumn("record", F.lit("g_1")), "genes": genes}, df, {})
    assert not [x for x in _plan(out).splitlines() if "BroadcastHashJoin" in x and ("query#" in x or "gene#" in x or "q#" in x)]
    assert {x.hits for x in out.collect()} == {1}


def test_words_are_compared_as_numbers(spark):
    """Seeds and words of up to 31 bases travel as numbers; what has other letters as text."""
    q, r = _inputs(spark)
    plan = _plan(search.mismatch_sites(q, r, "q", "record", "seq", 2, "both"))
    assert [x for x in _keyed_by(plan, "Exchange", "hashpartitioning(seed#") if "L, " in x.partition("seed#")[2][:10]]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(frame" in x]
    found = search.mismatch_sites(q, r, "q", "record", "seq", 0, "both").collect()
    assert {x.query for x in found if x.strand == "+"} == {x.q for x in q.collect()}


def test_short_words_travel_in_two_bytes(spark):
    """Words of a cell are most of what is copied to the cells; the first and last of eight bases fit too."""
    rows = [("a", "A" * 9 + "C"), ("b", "T" * 9)]
    df = spark.createDataFrame(rows, "name string, s string")
    got = search.shared_kmers(df, df, "name", "s", "name", "s", 8)
    assert "as smallint)" in _plan(got)
    assert {(x.target, x.record, x.share) for x in got.collect()} == {("a", "a", 1.0), ("b", "b", 1.0)}
