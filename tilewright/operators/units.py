"""Units of short oligos: records that hold all of a unit's oligos, met block by block, so that no oligo's own sites are moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import spread
from . import search, seeds
from .kmers import windows

#: Oligos of so many bases have chance sites in a part of all records; those of fewer or more, or with other letters, are searched one by one.
SHORT, LONG = 4, 11
#: Bases of a block of records that a task holds, about, and oligos that pass by it; sites that are compared at once, about.
BLOCK, FACING, AT_ONCE = 1 << 22, 1 << 21, 1 << 20
#: Oligos that a block of records is sorted for, at least.
LEAST = 1 << 14


class _Block:
    """A block of records: their names, and their words of k bases, in order, for each k that is asked for."""

    def __init__(self, pieces: list[pa.RecordBatch], mismatches: int):
        named = pa.chunked_array([p.column("record") for p in pieces]).combine_chunks().dictionary_encode(null_encoding="encode")
        self.names, self.mismatches = named.dictionary, mismatches
        texts = [x for p in pieces for x in p.column("seq").to_pylist()]
        code = np.zeros(256, np.int64)
        code[list(b"ACGT")] = range(4)
        self.n = np.array([len(x) for x in texts], np.int64)
        self.codes, self.owner = code[np.frombuffer("".join(texts).encode(), np.uint8)], named.indices.to_numpy(zero_copy_only=False)
        self.known: dict[int, tuple] = {}

    def _places(self, k: int) -> tuple:
        if k not in self.known:
            begin = np.cumsum(self.n) - self.n
            row = np.repeat(np.arange(self.n.size, dtype=np.int32), np.maximum(self.n - k + 1, 0))
            first = np.cumsum(np.maximum(self.n - k + 1, 0)) - np.maximum(self.n - k + 1, 0)
            at = (np.arange(row.size) - first[row]).astype(np.int32)
            word = windows(self.codes, k)[begin[row] + at].astype(np.int32)
            order = np.argsort(word, kind="stable")
            xors, counts = seeds.substitutions(k, self.mismatches)
            far = np.repeat(np.arange(len(counts)), np.diff([0, *counts]))
            begins = np.searchsorted(word[order], np.arange(4**k + 1))
            self.known[k] = begins, self.owner[row[order]].astype(np.int32), at[order], np.array(xors, np.int32), far
        return self.known[k]

    def sites(self, who: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit's number x records + record, start, mismatches) of each site of each word."""
        size = np.array([len(x) for x in words])
        out = []
        for k in np.unique(size):
            mine = np.flatnonzero(size == k)
            code = np.zeros(256, np.int64)
            code[list(b"ACGT")] = range(4)
            text = code[np.frombuffer("".join(words[i] for i in mine).encode(), np.uint8)].reshape(mine.size, k)
            packed = (text << 2 * np.arange(k - 1, -1, -1)).sum(axis=1).astype(np.int32)
            begins, owner, at, xors, far = self._places(int(k))
            near = (packed[:, None] ^ xors).ravel()
            a = begins[near]
            many = begins[near + 1] - a
            place = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            key = np.repeat(np.repeat(who[mine], xors.size), many) * len(self.names) + owner[place]
            out.append((key, at[place], np.repeat(np.tile(far, mine.size), many), np.full(key.size, k)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def _least(key: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its fewest mismatches."""
    both = np.sort(key * 4 + far)
    first = np.append(True, (both[1:] >> 2) != (both[:-1] >> 2)) if both.size else np.zeros(0, bool)
    return both[first] >> 2, both[first] & 3


def _whole(block: _Block, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Units that all oligos hit: the worst oligo's mismatches at its best place."""
    n = np.array([len(x) for x in words])
    key, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for j in range(n.max()):
        who = np.flatnonzero(n > j)
        k, _, f, _ = block.sites(who, [words[i][j] for i in who])
        k, f = _least(k, f)
        if j:
            done = n[key // len(block.names)] <= j
            _, x, y = np.intersect1d(key, k, assume_unique=True, return_indices=True)
            k, f = np.append(key[done], k[y]), np.append(far[done], np.maximum(far[x], f[y]))
        key, far = k, f
    return key, far


def _apart(block: _Block, words: list[list[str]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of two oligos that lie apart, at most so far: the worse oligo's mismatches at the best pair of places."""
    who = np.array([i for i, x in enumerate(words) if len(x) == 2], np.int64)
    if who.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = (block.sites(who, [words[i][j] for i in who]) for j in (0, 1))
    common = np.intersect1d(one[0], two[0])
    one, two = (tuple(x[np.isin(side[0], common)] for x in side) for side in (one, two))
    order = np.argsort(two[0], kind="stable")
    two = tuple(x[order] for x in two)
    a, b = np.searchsorted(two[0], one[0]), np.searchsorted(two[0], one[0], "right")
    x = np.repeat(np.arange(a.size), b - a)
    y = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(x.size)
    before, behind = two[1][y] - one[1][x] - one[3][x], one[1][x] - two[1][y] - two[3][y]
    ok = ((before >= 0) & (before <= gap)) | ((behind >= 0) & (behind <= gap))
    return _least(one[0][x[ok]], np.maximum(one[2][x[ok]], two[2][y[ok]]))


def _met(piece: pa.RecordBatch, block: _Block, gap: int | None, per_word: float) -> Iterator[pa.RecordBatch]:
    words = piece.column("words").to_pylist()
    step = max(1, int(AT_ONCE / max(1.0, per_word)))
    for a in range(0, len(words), step):
        now = words[a : a + step]
        key, far = _whole(block, now) if gap is None else _apart(block, now, gap)
        if key.size:
            unit = piece.column("unit").take(pa.array(key // len(block.names) + a))
            yield pa.RecordBatch.from_arrays([unit, block.names.take(pa.array(key % len(block.names))), pa.array(far.astype(np.int64))], ["unit", "record", "mismatches"])


def _cells(batches: Iterator[pa.RecordBatch], mismatches: int, gap: int | None) -> Iterator[pa.RecordBatch]:
    """Rows by cell, records before units: a block of records is held, units pass by."""
    cell, pieces, block = None, [], None
    for batch in batches:
        mark = 2 * batch.column("cell").to_numpy() + batch.column("side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(mark)) + 1), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if start == end:
                continue
            if mark[start] // 2 != cell:
                cell, pieces, block = mark[start] // 2, [], None
            piece = batch.slice(start, end - start)
            if mark[start] % 2 == 0:
                pieces.append(piece)
            elif pieces:
                block = block or _Block(pieces, mismatches)
                some = piece.column("words")[0].as_py()[0]
                per_word = len(seeds.substitutions(len(some), mismatches)[0]) * block.codes.size / 4 ** len(some)
                yield from _met(piece, block, gap, per_word)


def short_units(members: DataFrame, records: DataFrame, unit: str, query: str, record: str, seq: str, mismatches: int, gap: int | None = None) -> DataFrame:
    """(unit, record, mismatches): as ``search.units`` over the sites of all oligos on the sense strand, with the same result.

    Sites of an oligo of 10 bases grow with the product of oligos and records, while few records hold all oligos of a unit.
    So each block of records meets each block of units in a cell of its own, where sites are found and compared; only
    whole units leave it. A cell holds one block of records. Other oligos (see ``SHORT``), records with other letters
    or longer than a block, and with a gap units of over two oligos, are searched one by one from an index.
    """
    own = members.select(F.col(unit).alias("unit"), F.col(query).alias("query")).where("unit is not null and query is not null")
    units = spread(own, "unit").groupBy("unit").agg(F.array_sort(F.collect_set("query")).alias("words"))
    whole = records.select(F.col(record).cast("string").alias("record"), F.col(seq).alias("seq")).where(F.length("seq") > 0)
    strange = lambda c: F.length(F.translate(c, "ACGT", "")) > 0
    odd = F.exists("words", lambda x: (F.length(x) < SHORT) | (F.length(x) > LONG) | strange(x)) | ((F.size("words") > 2) if gap is not None else F.lit(False))
    of_units = units.agg(F.sum(F.size("words").cast("long")), F.max(odd.cast("int"))).first()
    of_records = whole.agg(F.sum(F.length("seq").cast("long")), F.max((strange("seq") | (F.length("seq") > BLOCK)).cast("int"))).first()
    if of_units[1] or of_records[1] or mismatches > 2:
        hits = seeds.indexed_sites(members, seeds.write_index(records, record, seq), query, mismatches, once=False)
        return search.units(members, hits, unit, query, gap)
    high = -(-(of_records[0] or 0) // BLOCK) or 1
    tasks = -(-int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) // high)
    wide = max(-(-(of_units[0] or 0) // FACING), min(tasks, -(-(of_units[0] or 0) // LEAST)), 1)
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    kind = members.select(F.col(unit)).schema[0].dataType
    if gap is not None:
        whole = whole.where("record is not null")
    r = whole.select((mine("record", high) * wide).alias("row"), F.lit(0).alias("side"), "record", "seq", F.lit(None).cast(kind).alias("unit"), F.lit(None).cast("array<string>").alias("words"))
    r = r.withColumn("cell", F.explode(F.sequence(F.col("row"), F.col("row") + wide - 1)))
    u = units.select(mine("unit", wide).alias("row"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("record"), F.lit(None).cast("string").alias("seq"), "unit", "words")
    u = u.withColumn("cell", F.explode(F.sequence(F.col("row"), F.col("row") + (high - 1) * wide, F.lit(wide).cast("long"))))
    columns = ["cell", "side", "record", "seq", "unit", "words"]
    cells = r.select(columns).unionAll(u.select(columns)).repartition(high * wide, "cell").sortWithinPartitions("cell", "side")
    out = StructType([StructField("unit", kind), StructField("record", StringType()), StructField("mismatches", LongType())])
    return cells.mapInArrow(lambda batches: _cells(batches, mismatches, gap), out).withColumnRenamed("unit", unit)
