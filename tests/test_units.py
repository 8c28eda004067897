"""Units of short oligos met by blocks, against the sites of each oligo."""

import random

import pytest

from tilewright.operators import search, units


def _made(n_units, odd=""):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    records = [(f"r{i % 40}", word(draw.choice([4, 9, 25, 60]))) for i in range(50)] + [("none", None), ("empty", "")]
    records += [("odd", odd + word(30))] if odd else []
    members = []
    for u in range(n_units):
        text = draw.choice([s for _, s in records if s and len(s) > 20])
        at = draw.randrange(len(text) - 18)
        for a, k in ((at, 5 + u % 4), (at + 10, 6)):
            w = list(text[a : a + k])
            w[draw.randrange(len(w))] = draw.choice("ACGT")
            members.append((u, "".join(w)))
    return [*members, (0, members[0][1]), (n_units, "ACGTA"), (None, "ACGTA"), (1, None)], records


@pytest.mark.parametrize("gap", [None, 6])
@pytest.mark.parametrize("odd", ["", "ACNNT"])
def test_units_of_blocks_are_those_of_all_sites(spark, monkeypatch, gap, odd):
    """Several blocks on both sides, records of one name, oligos of several lengths, units of one; no oligo's sites are moved."""
    monkeypatch.setattr(units, "BLOCK", 400)
    monkeypatch.setattr(units, "FACING", 20)
    monkeypatch.setattr(units, "AT_ONCE", 50)
    members, records = _made(30, odd)
    m, r = spark.createDataFrame(members, "unit long, w string"), spark.createDataFrame(records, "record string, r string")
    for most in (1, 2):
        got = units.short_units(m, r, "unit", "w", "record", "r", most, gap)
        if not odd:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "start0" not in plan
        want = search.units(m, search.mismatch_sites(m, r, "w", "record", "r", most), "unit", "w", gap)
        rows = [tuple(x) for x in got.select("unit", "record", "mismatches").collect()]
        assert sorted(rows) == sorted(tuple(x) for x in want.select("unit", "record", "mismatches").collect()) and len(rows) > 20


def test_units_of_nothing(spark):
    m, r = spark.createDataFrame([(1, "ACGTA")], "unit long, w string"), spark.createDataFrame([("a", "ACGTACG")], "record string, r string")
    assert units.short_units(m.limit(0), r, "unit", "w", "record", "r", 1).count() == 0
    assert units.short_units(m, r.limit(0), "unit", "w", "record", "r", 1).count() == 0
    assert [tuple(x) for x in units.short_units(m, r, "unit", "w", "record", "r", 1).collect()] == [(1, "a", 0)]
