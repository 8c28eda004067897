"""Substring dedup with difference-cover anchors: every stretch of words that stood earlier is found and removed.

A window is ``width`` consecutive words of one document (words: ``[^\\x20\\x09-\\x0D]+``, unchanged). A window repeats if
its words also start earlier: in a document of smaller key, or before it in its own. Words of repeating windows go;
all windows are judged on the input.

1. Anchors of ``width - period + 1`` words are hashed only where the place modulo the period lies in a difference
   cover. For any two places some shift below the period puts both into the cover, so two equal windows share an
   aligned anchor inside. Anchors are dealt by their hash; those that occur once are done with.
2. Places of anchors that occur again return to their documents, where each is extended to the windows around it:
   spans of their starts, a row a document. Windows are dealt by hash; all but the earliest place of each repeat. Of an anchor 32 bits are compared within a
   deal, as a false meeting only costs windows; of a window 64 beside the independent bits it is dealt by.
3. Places of repeating windows return to their documents, which drop the words they cover.

A task adds up equal anchors, and equal windows, of about ``GROUP_WORDS`` words before it sends them: one for all that
are alike, the others being known to repeat. So a passage in a third of all rows sends no more than a row a group. Hashes travel
packed, and deals grow in number with the words of the table, so a task holds a bounded share of them.

Rows with the same key and text are one document and get the same result each; rows of one key with different texts
are taken in the order of the texts' hashes, and rows without a key come last. Null has no words; an empty table gives
an empty one; further columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, free_name, release, shuffle_partitions
from .vectors import MULTIPLIER, SPACED, chunks, mix, row_bounds, span_hashes, window_hashes, words

WIDTH = 20
#: Perfect difference covers: fixed values. Each difference modulo the period is one of two elements.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
PERIOD = 7
GROUP_WORDS, GROUP_DOCS = 500_000, 50_000
BYTES_PER_DEAL = 24_000_000
LAST = (1 << 63) - 1
BLOB = 2_000


class Group:
    """Places of some documents, by the documents' order, until they are sent."""

    def __init__(self) -> None:
        self.names: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = 0

    def add(self, names: list[tuple[int, int]], own: np.ndarray, place: np.ndarray, first: np.ndarray, second: np.ndarray, n_words: int) -> None:
        self.parts.append((own + len(self.names), place, first, second))
        self.names += names
        self.words += n_words

    def full(self) -> bool:
        return self.words > GROUP_WORDS or len(self.names) > GROUP_DOCS

    def send(self, deals: int, bits: int, all_again: bool) -> Iterator[pa.RecordBatch]:
        """Rows (deal, hashes, own, place, names). One place of those alike goes with its hash, the earliest; the others
        go without, as known to repeat. ``all_again``: the earliest one is known to repeat too, so its hash goes alone."""
        if not self.parts:
            return
        own, place, first, second = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names, rank = np.unique(np.array(self.names, np.int64).reshape(-1, 2), axis=0, return_inverse=True)
        own = rank.reshape(-1)[own]
        by = np.lexsort((place, own, first))
        twice = np.zeros(len(by), bool)  # places of a document that came twice
        if len(by):
            twice[1:] = (first[by[1:]] == first[by[:-1]]) & (own[by[1:]] == own[by[:-1]]) & (place[by[1:]] == place[by[:-1]])
        by = by[~twice]
        own, place, first, second = own[by], place[by], first[by], second[by]
        new = np.ones(len(by), bool)
        new[1:] = first[1:] != first[:-1]
        again = ~new
        if all_again:
            again[:-1] |= ~new[1:]
        deal = (second >> np.uint64(32)).astype(np.int64) * deals >> 32
        yield from self._rows(deal[new], first[new], np.where(again, len(names), own)[new], place[new], names, bits)
        own, place = own[again], place[again]
        yield from self._rows(_home(names, deals)[own], None, own, place, names, bits)

    @staticmethod
    def _rows(deal: np.ndarray, hashes: np.ndarray | None, own: np.ndarray, place: np.ndarray, names: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
        if not len(deal):
            return
        by = np.lexsort((own, deal))
        deal, own, place = deal[by], own[by], place[by].astype("<u4")
        if hashes is not None:
            hashes = hashes[by].astype("<u8" if bits == 64 else "<u4")
        edges = np.flatnonzero(np.diff(deal)) + 1
        starts = [s for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(deal)], strict=True) for s in range(a, b, BLOB)]
        cols: list[list] = [[], [], [], [], []]
        for a, b in zip(starts, [*starts[1:], len(deal)], strict=True):
            there, at = np.unique(own[a:b], return_inverse=True)
            found = names[there[there < len(names)]]
            cells = int(deal[a]), None if hashes is None else hashes[a:b].tobytes(), at.astype("<u2").tobytes(), place[a:b].tobytes(), found.astype("<i8").tobytes()
            for c, x in zip(cols, cells, strict=True):
                c.append(x)
        types = [pa.int32(), *[pa.binary()] * 4]
        for a in range(0, len(cols[0]), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200], t) for c, t in zip(cols, types, strict=True)], ["deal", "hashes", "own", "place", "names"])


PACKED = "deal int, hashes binary, own binary, place binary, names binary"
SPANS = "key long, hash long, spans binary"


def _home(names: np.ndarray, deals: int) -> np.ndarray:
    """Where the places of each document are gathered."""
    return (mix(names.astype(np.uint64).sum(1)) >> np.uint64(32)).astype(np.int64) * deals >> 32


def _numbered(key: np.ndarray, hash_: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (key, hash) in order, and for each place, by document and place, its document's number."""
    by = np.lexsort((place, hash_, key))
    names = np.stack([key[by], hash_[by]], 1)
    new = np.ones(len(by), bool)
    new[1:] = (names[1:] != names[:-1]).any(1)
    return names[new], np.cumsum(new) - 1, place[by]


def _met(blobs: list[tuple], deals: int, bits: int, all_again: bool) -> Iterator[pa.RecordBatch]:
    """Places of what is known to repeat and of what meets another place with its hash, dealt by document."""
    key, hash_, place, hashes, asks = [], [], [], [], []
    for h, own, at, names in blobs:
        table = np.append(np.frombuffer(names, "<i8").reshape(-1, 2), [[0, 0]], 0)
        own_ = np.frombuffer(own, "<u2").astype(np.int64)
        key.append(table[own_, 0])
        hash_.append(table[own_, 1])
        place.append(np.where(own_ < len(table) - 1, np.frombuffer(at, "<u4").astype(np.int64), -1))  # -1: its place is known
        hashes.append(np.frombuffer(h, "<u8" if bits == 64 else "<u4").astype(np.uint64) if h is not None else np.zeros(len(own_), np.uint64))
        asks.append(np.full(len(own_), h is not None))
    k, x, p, h, ask = (np.concatenate(c) for c in (key, hash_, place, hashes, asks))
    del key, hash_, place, hashes, asks
    sure = ~ask
    a = np.flatnonzero(ask)
    by = a[np.lexsort((p[a], x[a], k[a], h[a]))]
    same = h[by[1:]] == h[by[:-1]]
    if all_again:
        met = np.zeros(len(by), bool)
        met[1:] |= same
        met[:-1] |= same
    else:  # the first place of a hash does not repeat, nor does the same place of a document that came twice
        new = np.append(True, ~same) if len(by) else np.zeros(0, bool)
        least = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        met = (k[by] != k[least]) | (x[by] != x[least]) | (p[by] != p[least])
    keep = np.append(by[met & (p[by] >= 0)], np.flatnonzero(sure))
    names, own, place = _numbered(k[keep], x[keep], p[keep])
    yield from Group._rows(_home(names, deals)[own], None, own, place, names, bits)


def _spans(blobs: list[tuple], before: int) -> Iterator[pa.RecordBatch]:
    """A row a document: the union of the spans from ``before`` ahead of each place to it, as pairs (start, end)."""
    tables = [np.frombuffer(names, "<i8").reshape(-1, 2)[np.frombuffer(own, "<u2")] for _, own, _, names in blobs]
    table, place = np.concatenate(tables), np.concatenate([np.frombuffer(at, "<u4").astype(np.int64) for _, _, at, _ in blobs])
    del tables
    names, own, place = _numbered(table[:, 0], table[:, 1], place)
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (place[1:] - before > place[:-1] + 1)
    last = np.append(first[1:], True)
    pairs = np.stack([np.maximum(place[first] - before, 0), place[last] + 1], 1).astype("<u4")
    bounds = np.searchsorted(own[first], np.arange(len(names) + 1))
    for a in range(0, len(names), 5_000):
        b = min(a + 5_000, len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[a:b, 0].copy()), pa.array(names[a:b, 1].copy()), pa.array([pairs[x:y].tobytes() for x, y in zip(bounds[a:b], bounds[a + 1 : b + 1], strict=True)], pa.binary())], ["key", "hash", "spans"])


def _dealt(packed: DataFrame, deals: int, done: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``done`` makes of all blobs of each deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_deal: dict[int, list[tuple]] = {}
        for batch in batches:
            for deal, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_deal.setdefault(deal, []).append(tuple(blobs))
        for deal in sorted(by_deal):
            yield from done(by_deal.pop(deal))
        pa.default_memory_pool().release_unused()

    return packed.repartitionById(deals, "deal").mapInArrow(run, schema)


def _meet(packed: DataFrame, deals: int, bits: int, all_again: bool, before: int) -> DataFrame:
    """(key, hash, spans): a row for each document with places that repeat. They travel packed, to their hash and back."""
    met = _dealt(packed, deals, lambda blobs: _met(blobs, deals, bits, all_again), PACKED)
    return _dealt(met, deals, lambda blobs: _spans(blobs, before), SPANS)


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds of the rows) of runs of rows."""
    for a, b, data, offsets in chunks(column):
        starts, ends, rows = words(data, offsets, SPACED)
        yield a, b, span_hashes(data, starts, ends), row_bounds(rows, b - a)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Second hashes, by which the first ones are dealt."""
    return mix(hashes * MULTIPLIER + np.uint64(0x2545F4914F6CDD1D))


def _cover_places(bounds: np.ndarray, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat places and rows of the anchors: cover places, with enough words left, of rows that have a window."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], n)
    take = np.isin(place % period, COVERS[period]) & (place + width - period < n[row]) & (n[row] >= width)
    return np.flatnonzero(take), row[take]


def repeated_anchors(docs: DataFrame, deals: int, width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """(key, hash, spans): starts of the windows of ``docs`` (key, hash, text) around anchors that occur more than once."""
    size = width - period + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group()
        for batch in batches:
            keys, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, h, bounds in _hashed(batch.column(2)):
                at, row = _cover_places(bounds, width, period)
                g = window_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
                group.add(list(zip(keys[a:b].tolist(), hashes[a:b].tolist(), strict=True)), row, at - bounds[row], g, _spread(g), len(h))
                if group.full():
                    yield from group.send(deals, 32, True)
                    group = Group()
        yield from group.send(deals, 32, True)
        pa.default_memory_pool().release_unused()

    return _meet(docs.select("key", "hash", "text").mapInArrow(emit, PACKED), deals, 32, True, period - 1)


def _each(spans: bytes, most: int) -> np.ndarray:
    """The numbers up to ``most`` of spans (start, end) that do not overlap."""
    a, b = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64).T
    size = np.clip(np.minimum(b, most + 1) - a, 0, None)
    return np.arange(int(size.sum())) + np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size)


def repeated_windows(docs: DataFrame, deals: int, width: int = WIDTH) -> DataFrame:
    """(key, hash, spans): starts of the windows that stand earlier too, of ``docs`` (key, hash, text, spans to look at)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group()
        for batch in batches:
            keys, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, h, bounds in _hashed(batch.column(2)):
                at, row = [], []
                for i, spans in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                    starts = _each(spans, int(bounds[i + 1] - bounds[i]) - width)
                    at.append(starts + bounds[i])
                    row.append(np.full(len(starts), i))
                at, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, row))
                g = window_hashes(h, width)[at] if len(at) else np.zeros(0, np.uint64)
                other = window_hashes(mix(h), width)[at] if len(at) else g
                group.add(list(zip(keys[a:b].tolist(), hashes[a:b].tolist(), strict=True)), row, at - bounds[row], g, other, len(at))
                if group.full():
                    yield from group.send(deals, 64, False)
                    group = Group()
        yield from group.send(deals, 64, False)
        pa.default_memory_pool().release_unused()

    return _meet(docs.select("key", "hash", "text", "spans").mapInArrow(emit, PACKED), deals, 64, False, 0)


def remove_repeats(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its words, those removed and the rest joined by a space (n_words, n_removed, kept).

    ``key`` is a whole number of up to 64 bits. Names that ``docs`` has already get an underscore before them.
    """
    if not 0 < period < width or period not in COVERS:
        raise ValueError(f"the period is one of {sorted(COVERS)} and less than the width")
    order, hash_ = F.coalesce(F.col(key).cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(order.alias("key"), hash_.alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deals = max(shuffle_partitions(docs.sparkSession), -(-total // BYTES_PER_DEAL))
    anchors = cut(repeated_anchors(rows, deals, width, period))
    windows = cut(repeated_windows(rows.join(anchors, ["key", "hash"]), deals, width))
    release(docs.sparkSession)
    names = free_name(docs, "key", "hash", "spans", "n_words", "n_removed", "kept")
    out = docs.withColumns({names[0]: order, names[1]: hash_})
    out = out.join(windows.select(*(F.col(c).alias(n) for c, n in zip(windows.columns, names[:3], strict=True))), [names[0], names[1]], "left").select(*docs.columns, names[2])
    schema = docs.select("*", F.lit(0).cast("long").alias(names[3]), F.lit(0).cast("long").alias(names[4]), F.lit("").alias(names[5])).schema

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
            for a in range(0, batch.num_rows, 100):
                some = batch.slice(a, 100)
                cols: list[list] = [[], [], []]
                for t, spans in zip(texts.slice(a, 100).to_pylist(), some.column(some.num_columns - 1).to_pylist(), strict=True):
                    w = t.split()  # on bytes: the white space of ASCII only
                    kept = w
                    if spans:
                        change = np.zeros(len(w) + 1, np.int64)
                        pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
                        np.add.at(change, pairs[:, 0], 1)
                        np.add.at(change, pairs[:, 1] - 1 + width, -1)
                        kept = list(compress(w, (np.cumsum(change[:-1]) == 0).tolist()))
                    for c, x in zip(cols, (len(w), len(w) - len(kept), b" ".join(kept)), strict=True):
                        c.append(x)
                new = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *new], [*some.schema.names[:-1], *names[3:]])

    return out.mapInArrow(drop, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p, true AS gone FROM r),
x AS (
  SELECT doc_id, count(*) AS n_words, count(gone) AS n_removed, string_agg(v, ' ' ORDER BY p) FILTER (gone IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d) LEFT JOIN c USING (doc_id, p)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
