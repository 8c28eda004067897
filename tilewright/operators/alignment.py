"""Gapped local alignment of short sequences with records: exact seeds by a join, affine extension in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import packed_bases, reverse_complement
from ..session import spread

# fixed values of the scoring
MATCH, MISMATCH, UNKNOWN, OPEN, EXTEND = 2, 6, 1, 5, 3
LEAST, LEAST_LOG = 20.0, 8.0

#: Bases of a sure run's word, at least, for seeds at every second place.
SELECTIVE = 12
#: Diagonals that one extension starts from; sites of neighbouring cells are compared afterwards.
WIDTH = 16
#: Bases of a record that travel together, at least; longer where a query reaches further.
CHUNK = 512
#: Bases of the words that a region is tried by before it is extended.
TRIED = 6
TRIED_AT_ONCE = 512
#: A score and the place it began share one integer: the score above, how early it began below.
PLACES = 1 << 20


def least_score(length: Column) -> Column:
    """The score that a site of a query of this length must reach."""
    return F.lit(LEAST) + LEAST_LOG * F.log(length)


def sure_seed(length: Column) -> Column:
    """The longest run of equal bases that every site of a sufficient score must hold; null if no score suffices.

    With e breaks, each of which costs a mismatch at least, m matches must pay for them, and the longest of e + 1 runs
    holds m / (e + 1) of them. The least over all e that a query's bases can pay for is sure.
    """
    most = F.floor((MATCH * length - least_score(length)) / MISMATCH).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda e: F.ceil(F.ceil((least_score(length) + MISMATCH * e) / MATCH) / (e + 1)).cast("int"))
    return F.when(most >= 0, F.array_min(runs))


def least_seeds(length: Column, k: Column) -> Column:
    """How many words of k equal bases every site of a sufficient score must hold, at least 1: e breaks leave e + 1 runs,
    and a run of r bases holds r - k + 1 words."""
    most = F.floor((MATCH * length - least_score(length)) / MISMATCH).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda e: (F.ceil((least_score(length) + MISMATCH * e) / MATCH) - (e + 1) * (k - 1)).cast("int"))
    return F.greatest(F.array_min(words), F.lit(1))


def sure_run(length: Column) -> Column:
    """As ``sure_seed``, of queries and records without an N, and longer: a break also costs what the bases it takes, or a
    gap of one, would have gained, so e breaks leave a score of 2 a base less 8 a break at most. Null if no score suffices."""
    most = F.floor((MATCH * length - least_score(length)) / (MISMATCH + MATCH)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda e: F.ceil(F.ceil((least_score(length) + MISMATCH * e) / MATCH) / (e + 1)).cast("int"))
    return F.when(most >= 0, F.array_min(runs))


def packed_seed(seed: Column) -> Column:
    """A seed as a number, with a 1 in front that tells its length; other letters and longer seeds by their hash."""
    return F.coalesce(packed_bases(seed).bitwiseOR(F.expr("shiftleft(1L, 2 * least(k, 31))")), F.xxhash64(seed))


def band(length: Column) -> Column:
    """The most bases of gaps that a site of a sufficient score can have."""
    return F.greatest(F.floor((MATCH * length - OPEN - least_score(length)) / EXTEND), F.lit(0)).cast("int")


def chunks(records: DataFrame, record: str, seq: str, size: int) -> DataFrame:
    """(record, blank, chunk, own, text): records cut into ``size`` bases in one linear pass; text goes on into the next piece; blank: with an N."""
    cut = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    r = records.where(F.length(seq) > 0).select(F.col(record).alias("record"), F.col(seq).contains("N").alias("blank"), cut.alias("c"))
    pairs = F.transform("c", lambda x, i: F.struct(i.cast("long").alias("chunk"), F.length(x).alias("own"), F.concat(x, F.coalesce(F.get("c", i + 1), F.lit(""))).alias("text")))
    return r.select("record", "blank", F.explode(pairs).alias("x")).select("record", "blank", "x.*")


def extend(queries: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best local alignment of each row of bytes with its region, by affine gaps.

    A region has one base for each of the query's and each diagonal; ``-`` stands beyond a record's ends. Of equal scores the
    first start counts, then the first end. All diagonals of all rows move on together, base by base of the query.
    """
    rows, n = queries.shape
    wide = regions.shape[1] - n + 1
    at = np.arange(wide, dtype=np.int64)
    low = np.int64(-(1 << 20)) * PLACES
    h = np.full((rows, wide), low)
    e = np.full((rows, wide), low)
    best, stop = np.full(rows, low), np.zeros(rows, np.int64)
    beyond = np.full((rows, 1), low)
    for i in range(n):
        base, there = queries[:, i : i + 1], regions[:, i : i + wide]
        unknown = (base == ord("N")) | (there == ord("N"))
        gain = np.where(unknown, -UNKNOWN, np.where(base == there, MATCH, -MISMATCH)).astype(np.int64)
        e = np.maximum(np.hstack([h[:, 1:], beyond]) - (OPEN + EXTEND) * PLACES, np.hstack([e[:, 1:], beyond]) - EXTEND * PLACES)
        h = np.maximum(np.maximum(h, PLACES - 1 - (at + i)) + gain * PLACES, e)
        h[there == ord("-")] = low
        e[there == ord("-")] = low
        f = np.maximum.accumulate(h + EXTEND * PLACES * at, axis=1) - EXTEND * PLACES * at - OPEN * PLACES
        h[:, 1:] = np.maximum(h[:, 1:], f[:, :-1] - EXTEND * PLACES)
        o = h.argmax(axis=1)
        top, end = h[np.arange(rows), o], i + o + 1
        better = (top > best) | ((top == best) & (end < stop))
        best, stop = np.where(better, top, best), np.where(better, end, stop)
    return best // PLACES, PLACES - 1 - best % PLACES, stop


def least_words(n: int, k: int = TRIED) -> int:
    """As ``least_seeds``, as a number: how many words of k equal bases every site of a sufficient score must hold; 0 or less says nothing."""
    least = LEAST + LEAST_LOG * np.log(n)
    return min((int(np.ceil((least + MISMATCH * e) / MATCH)) - (e + 1) * (k - 1) for e in range(int((MATCH * n - least) // (MISMATCH + MATCH)) + 1)), default=0)


def may_reach(queries: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Whether each row of bytes and its region hold so many equal words, on all diagonals, as a site of a sufficient score
    must; rows with an N, which costs less than a mismatch, always may. One byte a base and diagonal, where ``extend`` takes
    several numbers; a region that met by a chance seed seldom holds them."""
    rows, n = queries.shape
    need = least_words(n)
    if need <= 0:
        return np.ones(rows, bool)
    wide = regions.shape[1] - n + 1
    there = np.lib.stride_tricks.sliding_window_view(regions, wide, axis=1)
    same = there == queries[:, :, None]
    words = same[:, : n - TRIED + 1].copy()
    for i in range(1, TRIED):
        words &= same[:, i : n - TRIED + 1 + i]
    return (np.count_nonzero(words.reshape(rows, -1), axis=1) >= need) | (queries == ord("N")).any(1) | (regions == ord("N")).any(1)


def _letters(texts: pd.Series, n: int) -> np.ndarray:
    return np.frombuffer("".join(x.ljust(n, "-") for x in texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), n)


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for n, g in b.groupby(b["word"].str.len(), sort=False):
            reach = int(g["reach"].iloc[0])
            step = max(1, (1 << 21) // (reach - n + 1))
            for a in range(0, len(g), step):
                part = g.iloc[a : a + step]
                q, r = _letters(part["word"], n), _letters(part["region"], reach)
                may = np.concatenate([may_reach(q[i : i + TRIED_AT_ONCE], r[i : i + TRIED_AT_ONCE]) for i in range(0, len(part), TRIED_AT_ONCE)])
                if not may.any():
                    continue
                part = part[may]
                score, start, end = extend(q[may], r[may])
                out = part[["query", "strand", "record", "cell"]].copy()
                out["start0"], out["end0"], out["score"] = part["first"].to_numpy() + start, part["first"].to_numpy() + end, score
                yield out[score >= LEAST + LEAST_LOG * np.log(n)]


def local_sites(queries: DataFrame, records: DataFrame, query: str, record: str, seq: str, strand: str = "sense", shortest: int = 10, most: int | None = 100) -> DataFrame:
    """(query, strand, record, start0, end0, score): gapped local alignments that reach 20 + 8 ln(length).

    2 a match, -6 a mismatch, -1 beside an N, -5 - 3g a gap of g bases. Words of the sure length (``sure_seed``), at least
    ``shortest``, are joined by equality; a seed's diagonal falls into a cell of ``WIDTH`` diagonals, and each distinct cell is
    extended once over the diagonals that any sufficient gap can reach, if it and those a gap can reach hold as many seeds
    as every sufficient site must (``least_seeds``; an N costs less than a mismatch, so beside one a single seed will do). Where no
    record has an N, queries with a longer sure run (``sure_run``) are looked up by every second of its words. So where the sure length is at least ``shortest`` no
    site is missed; where it is less, those are missed whose longest run of equal bases is below ``shortest``. A site is the
    best alignment of its cell; equal ones count once, and of two in neighbouring cells that overlap the lower goes. The
    ``most`` best of a query over both strands are kept, ties by record, strand and start.

    Records travel in chunks and meet cells by (record, chunk), so neither a long record nor its words sit in one task.
    Queries and records that are null or empty have no sites; a query that stands twice is one.
    """
    signs = {"sense": ["+"], "antisense": ["-"], "both": ["+", "-"]}[strand]
    words = F.array(*[F.struct(F.lit(s).alias("strand"), (F.col("query") if s == "+" else reverse_complement("query")).alias("word")) for s in signs])
    q = queries.select(F.col(query).alias("query")).where("query <> ''")
    q = spread(q, "query").distinct().select("query", F.explode(words).alias("x")).select("query", "x.*")
    n = F.length("word")
    q = q.withColumn("k", F.greatest(sure_seed(n), F.lit(shortest))).where(sure_seed(n).isNotNull() & (F.col("k") <= n)).withColumn("band", band(n))
    q = q.withColumns({"hits": F.when(F.col("word").contains("N"), 1).otherwise(least_seeds(n, F.col("k"))), "step": F.lit(1)})
    if not records.agg(F.max(F.col(seq).contains("N"))).first()[0]:  # a long sure run is met by every second of its words but one base shorter
        q = q.withColumn("run", F.when(~F.col("word").contains("N"), sure_run(n))).withColumn("long", F.coalesce(F.col("run") - 1 >= F.greatest(F.col("k"), F.lit(SELECTIVE)), F.lit(False)))
        q = q.withColumns({"k": F.when(F.col("long"), F.col("run") - 1).otherwise(F.col("k")), "step": F.when(F.col("long"), 2).otherwise(1), "hits": F.when(F.col("long"), 1).otherwise(F.col("hits"))}).drop("run", "long")
    longest = q.agg(F.max(F.lit(WIDTH - 1) + 2 * F.col("band") + n), F.max("k"), F.max("band")).first()  # one row: how far a query reaches
    pieces = chunks(spread(records.select(record, seq), record), record, seq, max(CHUNK, longest[0] or 0, longest[1] or 0))
    size = max(CHUNK, longest[0] or 0, longest[1] or 0)
    sown = q.withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("k") + 1, F.col("step")))).withColumn("seed", F.substring(F.col("word"), F.col("at"), F.col("k"))).where(~F.col("seed").contains("N"))
    sown = sown.select("query", "strand", "band", "hits", "at", packed_seed(F.col("seed")).alias("seed"))  # the word follows from query and strand
    lengths = q.select("k").distinct()  # as many as queries have lengths
    places = pieces.join(F.broadcast(lengths), F.length("text") >= F.col("k")).withColumn("s", F.explode(F.sequence(F.lit(1), F.least("own", F.length("text") - F.col("k") + 1))))
    places = places.select("record", "blank", (F.col("chunk") * size + F.col("s")).alias("place"), packed_seed(F.substring(F.col("text"), F.col("s"), F.col("k"))).alias("seed"))
    met = sown.hint("merge").join(places, "seed").select("query", "strand", "band", F.when(F.col("blank"), 1).otherwise(F.col("hits")).alias("hits"), "record", F.floor((F.col("place") - F.col("at")) / WIDTH).alias("cell"))
    cells = met.repartition("query", "strand", "record").groupBy("query", "strand", "band", "hits", "record", "cell").agg(F.count("*").alias("seeds"))
    beside = (longest[2] or 0) // WIDTH + 1  # cells that a site's gaps can reach
    around = Window.partitionBy("query", "strand", "record").orderBy("cell").rangeBetween(-beside, beside)
    cells = cells.withColumn("seeds", F.sum("seeds").over(around)).where(F.col("seeds") >= F.col("hits")).drop("seeds", "hits")
    cells = cells.withColumn("word", F.when(F.col("strand") == "+", F.col("query")).otherwise(reverse_complement("query")))
    cells = cells.withColumn("first", F.col("cell") * WIDTH - F.col("band")).withColumn("reach", F.lit(WIDTH - 1) + 2 * F.col("band") + n)
    begin = F.greatest("first", F.lit(0).cast("long"))
    cells = cells.withColumn("chunk", F.floor(begin / size)).hint("merge").join(pieces.select("record", "chunk", "text"), ["record", "chunk"])
    before = (begin - F.col("first")).cast("int")
    inside = F.substring(F.col("text"), (begin - F.col("chunk") * size + 1).cast("int"), (F.col("reach") - before).cast("int"))
    cells = cells.withColumn("region", F.concat(F.repeat(F.lit("-"), before), inside)).select("query", "strand", "word", "record", "cell", "first", "reach", "region")
    kind = records.select(F.col(record).alias("record")).schema["record"].dataType.simpleString()
    found = cells.mapInPandas(_extended, f"query string, strand string, record {kind}, cell long, start0 long, end0 long, score long")
    return _best(found, most)


def _best(found: DataFrame, most: int | None) -> DataFrame:
    near = Window.partitionBy("query", "strand", "record").orderBy("cell")
    here = F.struct("cell", "start0", "end0", "score")

    def beaten(other: Column) -> Column:
        close = F.abs(other["cell"] - F.col("cell")) == 1
        return F.coalesce(close & (other["score"] > F.col("score")) & (other["start0"] < F.col("end0")) & (F.col("start0") < other["end0"]), F.lit(False))

    kept = found.withColumn("before", F.lag(here).over(near)).withColumn("after", F.lead(here).over(near)).where(~beaten(F.col("before")) & ~beaten(F.col("after")))
    kept = kept.select("query", "strand", "record", "start0", "end0", "score").distinct()
    if most is None:
        return kept
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "record", "strand", "start0", "end0"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
