"""Scalar functions against published values and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import barcodes, thermo
from tilewright.functions import sequence as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "seq", "want"),
    [
        (lambda s: thermo.tm_primer(s), "GTATGACAATGAA", 27.278686288556173),
        (lambda s: thermo.tm_padlock(s, 75, 10, 100, 20), "CCCATCTCAGTCCTTCTCGCGGCCCTCCTG", 70.50057357343485),
        (lambda s: thermo.tm_miner(s, 390, 25, 50), "CCCCATCCTTATTCCCTTTAAGAACGTTCTGATGGGC", 42.85),
        (lambda s: thermo.rna_dna_37(s), "TAATCACACATTTCTTCTGGAATCTCATGTGG", -32.078494),
    ],
)
def test_published_values(spark, f, seq, want):
    assert one(spark, f("s"), s=seq) == pytest.approx(want, abs=1e-6)


def test_bad_sequences_are_null(spark):
    for s in ("ACGN", "", "A"):
        assert one(spark, thermo.tm_primer("s"), s=s) is None
    assert one(spark, S.gc_content("s"), s="") is None
    assert one(spark, S.reverse_complement("s"), s="ACRT") is None
    assert one(spark, thermo.rna_dna_37("s"), s="A") is None


def test_against_python(spark):
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randint(1, 30))) for _ in range(60)]
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select(
        "s", S.max_homopolymer("s").alias("run"), S.max_window_count("s", "CG", 5).alias("win"), S.self_match("s").alias("self"), S.base_fraction("s", "A", (-4, -2)).alias("part"),
        S.kmers("s", 3).alias("kmers"), S.occurrences("s", F.lit("AC")).alias("occ"),
    ).collect()
    for x in got:
        s = x["s"]
        assert x["run"] == max(len(p) for b in "ACGT" for p in "".join(c if c == b else " " for c in s).split() or [""])
        assert x["win"] == max(sum(c in "CG" for c in s[i : i + 5]) for i in range(max(1, len(s) - 4)))
        rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert x["self"] == sum(s[i : i + 4] == rc[j : j + 4] and i + j + 2 != len(s) for i in range(len(s) - 3) for j in range(len(s) - 3))
        p = s[max(len(s) - 4, 0) : max(len(s) - 1, 0)]
        assert x["part"] == (pytest.approx(p.count("A") / len(p)) if p else None)
        assert x["kmers"] == [s[i : i + 3] for i in range(len(s) - 2)]
        assert x["occ"] == [i + 1 for i in range(len(s)) if s.startswith("AC", i)]


def test_temperature_difference_needs_equal_conditions(spark):
    df = spark.range(1).select(F.lit(2.0).alias("a"), F.lit(5.0).alias("b"), F.lit(None).cast("double").alias("c"))
    x = df.select(thermo.tm_difference([F.col("a"), F.col("b")], [1, 1]).alias("x"), thermo.tm_difference([F.col("a"), F.col("b")], [1, 2]).alias("y"), thermo.tm_difference([F.col("a"), F.col("c")], [1, 1]).alias("z")).first()
    assert (x["x"], x["y"], x["z"]) == (3.0, None, None)


def test_barcodes_share_no_word():
    for found, k in ((barcodes.walk(30, 14, 6, gc=(40, 60), prevent=("GGG",)), 6), (barcodes.max_size(12, 5, 50), 5)):
        words = [w for b in found for s in (b, b[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in {s[i : i + k] for i in range(len(s) - k + 1)}]
        assert found and len(words) == len(set(words))
    assert all("GGG" not in b and "CCC" not in b and 6 <= sum(c in "GC" for c in b) <= 8 for b in barcodes.walk(30, 14, 6, gc=(40, 60), prevent=("GGG",)))


def test_stem_score(spark):
    assert one(spark, thermo.stem_score("s"), s="GGGGCCAAAAGGCCCC") == 6
    assert one(spark, thermo.stem_score("s"), s="AAAAAAAAAAAA") == 0
