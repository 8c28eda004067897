"""k-mer counts by runs against a plain count."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import kmers, search

FLIP = str.maketrans("ACGT", "TGCA")


def plain(texts, k, both):
    out = Counter()
    for t in texts:
        for i in range(len(t or "") - k + 1):
            w = t[i : i + k]
            if set(w) <= set("ACGT"):
                out[min(w, w[::-1].translate(FLIP)) if both else w] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    shared = dna(120)
    return [dna(700), shared, shared, shared[::-1].translate(FLIP), dna(40) + "N" + dna(40) + "acgt" + dna(30), "A" * 900, "AT" * 200, "", None, "ACG", dna(11), dna(64) + "\n" + dna(64)]


@pytest.mark.parametrize("k", [2, 11, 18, 24, 27])
@pytest.mark.parametrize("both", [True, False])
def test_counts(spark, texts, monkeypatch, k, both):
    monkeypatch.setattr(kmers, "CHUNK", 128)
    rows = kmers.counts(spark.createDataFrame([(t,) for t in texts], "s string"), "s", k, both).collect()
    assert len(rows) == len({x.kmer for x in rows}) and {x.kmer: x.n for x in rows} == plain(texts, k, both)


@pytest.mark.parametrize("k", [kmers.FEW, kmers.FEW + 1, kmers.MOST, kmers.MOST + 1])
def test_tables_on_both_sides_of_the_lengths(spark, texts, k):
    rows = search.kmer_table(spark.createDataFrame([(t,) for t in texts], "s string"), "s", k).collect()
    assert {x.kmer: x.n for x in rows} == plain(texts, k, True)


def test_one_shuffle_of_few_rows(spark):
    r = random.Random(2)
    texts = spark.createDataFrame([("".join(r.choices("ACGT", k=20_000)),) for _ in range(8)] + [("A" * 60_000,)], "s string")
    plan = kmers.counts(texts, "s", 18)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    rows = kmers.runs(texts, "s", 18).select("times", F.explode("runs").alias("run")).withColumn("size", F.expr("cast((length(bin(run)) - 1) / 2 as int)"))
    n, words = rows.select(F.count("*"), F.sum(F.col("times") * (F.col("size") - 17))).first()
    assert words == 8 * 19_983 + 59_983
    assert n * 4 < 8 * 19_983  # a row of text a word before; the repeat of one base adds a handful
    assert rows.where("size >= 18 and run = shiftleft(1L, 2 * size)").count() < 40


def test_windows_and_minimizers():
    codes = np.random.default_rng(3).integers(0, 4, 200)
    for length in (1, 2, 5, 9, 16, 31):
        want = [sum(int(c) << 2 * (length - 1 - j) for j, c in enumerate(codes[i : i + length])) for i in range(200 - length + 1)]
        assert kmers.windows(codes, length).tolist() == want
    assert kmers.windows(codes[:3], 5).size == 0
    turned = kmers.minimizers(3 - codes[::-1], 18, 9, True)[::-1]
    assert (turned == kmers.minimizers(codes, 18, 9, True)).all()


def test_runs_are_dealt_to_tasks_that_can_count_them(spark):
    """Runs hold many times their bytes in words, so tasks are not put together by these; and words are not moved again."""
    df = kmers.counts(spark.createDataFrame([("ACGT" * 40,)], "s string"), "s", 24)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
