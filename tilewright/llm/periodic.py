"""Periodic run detection by the runs theorem.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words long, that no
neighbouring word extends keeping period q. Words are the runs of bytes ``[^\\x20\\x09-\\x0D]+``, taken as they are.

1. Stretches without a repeated window hold no run and are left out: a run of length L and period q is covered by
   the two copies of windows of ``least - least // times`` words, q apart. Equal hashes only add stretches.
2. Suffixes of a stretch are ordered by prefix doubling; the ranks of each doubling give the LCP of neighbours.
3. The longest Lyndon words under an order of the words and its reverse begin at each place and end before the next
   smaller, or next greater, value of the inverse suffix array. Each run has one of them as its root.
4. A root is extended to both sides by the smallest LCP between two suffixes, in the stretch and in its reverse. The
   sparse table of these minima is made a row at a time, and a row answers all questions of its width.

Each row is handled by itself in one pass without a shuffle; rows are taken in chunks of about half a megabyte, and
memory is about 4 bytes a word and doubling in the stretches with repeats. Null and texts without words have no run;
an empty table gives an empty one, repeated rows give repeated results, further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import free_name
from .vectors import window_hashes

LEAST, TIMES = 24, 3
CHUNK_BYTES = 500_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated_stretches(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches covered by windows of ``width`` words that occur again in their row."""
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none
    g = window_hashes(h, width)
    at = np.flatnonzero(rows[: len(g)] == rows[width - 1 :])
    g = g[at] ^ (rows[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = at[again]
    if not len(at):
        return none, none
    apart = (at[1:] > at[:-1] + width) | (rows[at[1:]] != rows[at[:-1]])
    return at[np.append(True, apart)], at[np.append(apart, True)] + width


class Suffixes:
    """The order of all suffixes of stretches (each ends with its stretch) and the longest common prefix of any two."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray):
        """``letters``: numbers, different in different stretches; ``ends``: for each place the end of its stretch."""
        n = len(letters)
        order = np.argsort(letters, kind="stable")
        new = np.append(True, letters[order[1:]] != letters[order[:-1]])
        slot = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
        levels, width = [self._level(rank)], 1
        single = new & np.append(new[1:], True)
        active = order[~single]
        while len(active):
            after = active + width
            second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[active] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            group = rank[active]
            first = np.append(True, group[1:] != group[:-1])
            index = np.arange(len(active))
            slot = group + index - np.maximum.accumulate(np.where(first, index, 0))
            new = np.append(True, key[1:] != key[:-1])
            rank[active] = np.maximum.accumulate(np.where(new, slot, 0))
            levels.append(self._level(rank))
            width *= 2
            active = active[~(new & np.append(new[1:], True))]
        self.rank = rank
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        x, y = place[:-1].copy(), place[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            jump = (levels[k][x] == levels[k][y]) << k
            x += jump
            y += jump
        self.lcp = np.append(0, x - place[:-1])

    @staticmethod
    def _level(rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int32 if len(rank) < 1 << 31 else np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at i and j (which differ): least LCP between their ranks."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        by = np.argsort(level, kind="stable")
        at = np.searchsorted(level[by], np.arange(level.max() + 2)) if len(i) else np.zeros(1, np.int64)
        row = self.lcp
        for k in range(len(at) - 1):
            q = by[at[k] : at[k + 1]]
            out[q] = np.minimum(row[low[q]], row[high[q] + 1 - (1 << k)])
            row = np.minimum(row[: -(1 << k)], row[1 << k :]) if len(row) > 1 << k else row[:0]
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value, or the end."""
    out = [len(values)] * len(values)
    open_: list[int] = []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs(letters: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of the stretches, by start and period. ``letters`` and ``ends`` as in Suffixes."""
    found = []
    n = len(letters)
    forward = Suffixes(letters, ends)
    for values in (forward.rank, -forward.rank):
        i = np.arange(n)
        j = np.minimum(next_smaller(values.tolist()), ends)
        i = i[j < ends]
        j = j[i]
        reach = forward.common(i, j)
        # the leftmost root of a run begins within its first period, so its suffix agrees at least so far
        long = reach >= np.maximum(np.maximum(least, times * (j - i)) - 2 * (j - i) + 1, 1)
        found.append(np.stack([j[long] + reach[long], j[long] - i[long], i[long]], 1))
    roots = np.concatenate(found)
    if not len(roots):
        return np.zeros((0, 3), np.int64)
    roots = roots[np.lexsort((roots[:, 2], roots[:, 1], roots[:, 0]))]
    one = np.append(True, (roots[1:, :2] != roots[:-1, :2]).any(1))  # roots of one run end it together
    end, period, i = roots[one].T
    starts = np.append(True, ends[1:] != ends[:-1])
    begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    back = Suffixes(letters[::-1].copy(), (n - begin)[::-1].copy())
    inner = i > begin[i]
    i[inner] -= back.common(n - i[inner], n - i[inner] - period[inner])
    length = end - i
    out = np.stack([i, length, period], 1)[length >= np.maximum(least, times * period)]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def text_runs(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[list[bytes], np.ndarray]]:
    """Each text's words and its runs as rows (start, length, period)."""
    words = [t.split() for t in texts]  # on bytes: the white space of ASCII only
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.append(0, np.cumsum(sizes))
    h = np.fromiter((hash(x) for w in words for x in w), np.int64, int(begin[-1])).view(np.uint64)
    rows = np.repeat(np.arange(len(words)), sizes)
    a, b = repeated_stretches(h, rows, least - least // times)
    a, b = a[b - a >= least], b[b - a >= least]
    none = np.zeros((0, 3), np.int64)
    if not len(a):
        return [(w, none) for w in words]
    size = b - a
    stretch = np.repeat(np.arange(len(a)), size)
    places = np.arange(int(size.sum())) + np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size)
    letters = np.unique(h[places], return_inverse=True)[1] + stretch * (int(begin[-1]) + 1)
    got = runs(letters, np.repeat(np.cumsum(size), size), least, times)
    got[:, 0] = places[got[:, 0]]
    row = rows[got[:, 0]]
    got[:, 0] -= begin[row]
    bounds = np.searchsorted(row, np.arange(len(words) + 1))
    return [(w, got[bounds[k] : bounds[k + 1]]) for k, w in enumerate(words)]


def without_repeats(words: list[bytes], found: np.ndarray) -> bytes:
    """The words, joined by a space, without those that a run contains after its first period."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, runs_name: str = "runs", collapsed_name: str = "collapsed") -> DataFrame:
    """``df`` with each text's runs (start, length, period; by start, then period) and its text without their repeats.

    Names that ``df`` has already get an underscore before them.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    runs_name, collapsed_name = free_name(df, runs_name, collapsed_name)
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    schema = df.select("*", none.alias(runs_name), F.lit("").alias(collapsed_name)).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)
            chunk = np.cumsum(sizes) // CHUNK_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                got = text_runs(texts.slice(a, b - a).to_pylist(), least, times)
                flat = np.concatenate([f for _, f in got])
                items = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for _, f in got])), pa.int32()), items)
                kept = pa.array([without_repeats(w, f) for w, f in got], pa.binary()).cast(pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, kept], [*part.schema.names, runs_name, collapsed_name])

    return df.mapInArrow(find, schema)


def strongest(runs_: Column) -> Column:
    """The run of the greatest length / period, exactly; ties: the smallest start, then period. Null without a run."""

    def better(best: Column, r: Column) -> Column:
        here, there = r["length"] * best["period"], best["length"] * r["period"]
        earlier = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when((here > there) | ((here == there) & earlier), r).otherwise(best)

    return F.when(F.size(runs_) > 0, F.aggregate(runs_, F.get(runs_, F.lit(0)), better))


def looped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with loops planted: with h = crc32(key as text) and g = h div 10, in each text of n > 0 words with
    h % 10 = 0 the words from a = g % n on repeat the first p = 1 + (n - a) div (3 + g % 8) of them up to the end.

    Such a text's words are joined by a space; others, and those without a key, stay.
    """
    (w, h) = free_name(docs, "words_", "crc_")
    chosen = F.col(h) % 10 == 0
    rows = docs.withColumn(h, F.crc32(F.col(key).cast("string").cast("binary")))
    rows = rows.withColumn(w, F.when(chosen, F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")))
    n, g = F.size(w), F.floor(F.col(h) / 10).cast("long")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(F.col(w), a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(F.col(w), F.lit(1), a), F.slice(loop, F.lit(1), n - a)), " ")
    return rows.withColumn(text, F.when(n > 0, changed).otherwise(F.col(text))).drop(w, h)


def run_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document of ``looped(docs)``: n_runs, its strongest run, digests of its runs and of its collapsed text."""
    rows = periodic_runs(looped(docs.select(key, text), key, text), text)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.select(key, "runs", strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
