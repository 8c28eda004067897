"""Folding against all structures of short sequences, each loop's energy found by itself."""

import random

import pytest

from tilewright.functions import folding as f
from tilewright.plans import protocol


def structures(n, i=0):
    """All sets of pairs without crossings, hairpins of three bases or more; pairs as a tuple."""

    def over(a, b):
        if b - a < 4:
            return [()]
        out = list(over(a + 1, b))
        for k in range(a + 4, b + 1):
            out += [((a, k), *x, *y) for x in over(a + 1, k - 1) for y in over(k + 1, b)]
        return out

    return over(0, n - 1)


def energy(s, pairs):
    """Sum over loops; None if a pair is none or an interior loop is too large."""
    kind = lambda p: f.PAIRS.index(s[p[0]] + s[p[1]])
    weak = lambda p, x: x if kind(p) > 1 else 0
    if any(s[a] + s[b] not in f.PAIRS for a, b in pairs):
        return None
    total = 0
    inner = lambda a, b: [p for p in pairs if a < p[0] and p[1] < b and not any(a < q[0] < p[0] and p[1] < q[1] < b for q in pairs)]
    for p in pairs:
        below = inner(*p)
        if not below:
            total += f.loop_cost(f.HAIRPIN, 3, p[1] - p[0] - 1) + weak(p, f.END)
        elif len(below) > 1:
            total += f.CLOSING + f.BRANCH * (1 + len(below)) + weak(p, f.END) + sum(weak(q, f.END) for q in below)
        else:
            q = below[0]
            a, b = q[0] - p[0] - 1, p[1] - q[1] - 1
            if a + b > f.MOST_INSIDE:
                return None
            if not a and not b:
                total += f.STACKS[kind(p)][f.PAIRS.index(s[q[1]] + s[q[0]])]
            elif a and b:
                total += f.loop_cost(f.INTERIOR, 2, a + b) + min(f.MOST_UNEQUAL, f.UNEQUAL * abs(a - b)) + weak(p, f.END_INSIDE) + weak(q, f.END_INSIDE)
            elif a + b == 1:
                total += f.loop_cost(f.BULGE, 1, 1) + f.STACKS[kind(p)][f.PAIRS.index(s[q[1]] + s[q[0]])]
            else:
                total += f.loop_cost(f.BULGE, 1, a + b) + weak(p, f.END) + weak(q, f.END)
    return total + sum(weak(p, f.END) for p in pairs if not any(q[0] < p[0] and p[1] < q[1] for q in pairs))


def best(s, offset=0):
    found = []
    for pairs in structures(len(s)):
        if (e := energy(s, pairs)) is not None:
            found.append((e, sum((a >= offset) + (b >= offset) for a, b in pairs)))
    return min(found)


@pytest.mark.parametrize("n", [1, 4, 5, 8, 11, 14, 16])
def test_all_structures(n):
    r = random.Random(n)
    texts = ["".join(r.choices("GCAU" if k % 2 else "GGCCU", k=n)) for k in range(25 if n < 16 else 8)]
    offsets = [r.randint(0, n) for _ in texts]
    e, p = f.fold_all(texts, offsets)
    for s, o, x, y in zip(texts, offsets, e, p, strict=True):
        assert (round(x * 100), int(y)) == best(s, o), (s, o)


def test_multiloops(monkeypatch):
    """With cheap loops, three helices around one loop are found among all structures of 16 bases."""
    monkeypatch.setattr(f, "CLOSING", -2000)
    r = random.Random(1)
    texts = ["".join(r.choices("GC", k=16)) for _ in range(6)] + ["GGAAACGAAACC" + "AAAA"]
    e, p = f.fold_all(texts)
    assert [(round(x * 100), int(y)) for x, y in zip(e, p, strict=True)] == [best(s) for s in texts]


def test_letters_and_columns(spark):
    rows = [("GGGGAAAACCCC",), ("ggggaaaacccc",), ("GGGGTTTTCCCC",), ("GGGGNNNNCCCC",), ("",), (None,), ("ACGT",)]
    got = spark.createDataFrame(rows, "s string").select(f.fold_score("s").alias("e"), f.blocks("s", 8).alias("b")).collect()
    e = [x.e for x in got]
    assert e[0] == e[1] == e[3] > 0 and e[6] == 0 and [x.b for x in got[:2]] == [4, 4]
    assert all(x.e is None or x.e != x.e for x in got[4:6])
    long = "".join(random.Random(2).choices("ACGT", k=300))
    assert f.fold_all([long])[0][0] < -10


def test_folding_in_a_protocol(spark):
    p = {"targets": [], "extracts": {"target_region": {"length": 12, "step": 12}}, "probes": {"probe": {"expr": "target_region"}}, "attributes": {"fold": {"type": "fold_score", "target": "probe"}, "tight": {"type": "blocks", "target": "probe", "offset": 6}}, "post_process": {"filters": {"fold": {"condition": "fold <= 1"}}}}
    out = protocol.run(p, spark.createDataFrame([("t", "GGGGAAAACCCC" + "ACACACACACAC")], "target string, seq string")).collect()
    assert [(r.start, r.fold, r.tight) for r in out] == [(13, 0.0, 0.0)]
    assert any("37" in x for x in protocol.analyse(p | {"hybridization": {"temperature_c": 50}}))
