"""Quality classifier by co-training on two views of a document.

The text view is the hashed words and byte shapes of the text; the metadata view is what stands around it: source,
language, length, and counts of lines, capitals, digits and signs. Two logistic regressions learn from a bounded set
of labelled rows. In each round both views score every document outside that set, and what one is sure of
becomes a pseudo-label for the other: counts of its buckets by class, summed by Spark over all documents. Their log
ratios are the starting weights of the other view's next fit, so that words that no labelled row has get a weight too.
The scores are calibrated on one held-out part of the labelled rows and combined on another.

``score`` is the probability that a document is good (quality 1), ``toxic_score`` that it is toxic; ``keep`` is true
where it is judged good and not toxic. Null is the empty text. Rows are independent: repeated rows stay and count as
often as they stand, an empty table gives an empty one. Without labels both scores are 0.5 and everything is kept.
Conflicting labels of a document all count; null labels are left out. Rows without a key are unlabelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .vectors import ALNUM, SPACED, byte_class, chunks, lower_ascii, row_bounds, span_hashes, words

TEXT_DIMS = 1 << 16
META_DIMS = 1 << 10
#: The fit's bound: labelled rows, those with the smallest hashes. Unlabelled documents all take part.
LABELLED = 6_000
ROUNDS = 3
#: A view is sure of a label beyond this log odds (0.95 or 0.05).
SURE = float(np.log(19))

_CLASSES = [byte_class([(65, 90)]), byte_class([(97, 122)]), byte_class([(48, 57)]), byte_class([(33, 47), (58, 64), (91, 96), (123, 126)]), byte_class([(32, 32)]), byte_class([(10, 10)]), byte_class([(128, 255)]), byte_class([(33, 33)]), byte_class([(124, 124)])]

_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


def text_view(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct buckets of each row's words, of the shapes of its tokens, and of how much it repeats itself."""
    low = lower_ascii(data)
    s, e, row = words(low, offsets, ALNUM)
    h = span_hashes(low, s, e)
    s2, e2, row2 = words(data, offsets, SPACED)
    total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.stack([c[data] for c in (_CLASSES[0], _CLASSES[2], _CLASSES[3], _CLASSES[6])], 1), 0)])
    part = (total[e2] - total[s2]) > np.array([1, 0, 1, 0])
    shape = (part @ np.array([1, 2, 4, 8])).astype(np.int64)
    n = len(offsets) - 1
    at, at2 = row_bounds(row, n), row_bounds(row2, n)
    h = (h >> np.uint64(40)).astype(np.int64) % (TEXT_DIMS - 128) + 128
    again = np.zeros(len(h) + 1, np.int64)
    if len(h):
        again[2:] = np.cumsum((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    out = []
    for i in range(n):
        w = np.unique(h[at[i] : at[i + 1]])
        c = np.bincount(shape[at2[i] : at2[i + 1]], minlength=16)[:16]
        share = np.minimum(3, (c * 4 // max(1, c.sum())))
        size = max(1, at[i + 1] - at[i])
        repeats = (again[at[i + 1]] - again[at[i]]) / size
        rest = [64 + int(np.digitize(repeats, _STEPS)), 80 + int(np.digitize(len(w) / size, _STEPS))]
        out.append(np.concatenate([np.flatnonzero(c) * 4 + share[c > 0], rest, w]))
    return out


def meta_view(data: np.ndarray, offsets: np.ndarray, source: list, lang: list) -> list[np.ndarray]:
    """Buckets of source, language, length and of the shares of kinds of characters."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = []
    row = np.repeat(np.arange(n), size)
    shares = [np.bincount(row, c[data], n) / np.maximum(1, size) for c in _CLASSES]
    levels = [np.digitize(x, [0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6]) for x in shares]
    length = np.digitize(np.log2(size + 1), np.arange(2, 20))
    for i in range(n):
        own = [f"s={source[i]}", f"l={lang[i]}"]
        f = [zlib.crc32(x.encode()) % (META_DIMS - 256) + 256 for x in own]
        out.append(np.unique([length[i], *(20 + 12 * k + int(v[i]) for k, v in enumerate(levels)), *f]))
    return out


@dataclass
class Rows:
    """Buckets of many rows end to end: row i has ``col[at[i]:at[i + 1]]``."""

    col: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def of(self, chosen: np.ndarray) -> Rows:
        """The rows where ``chosen`` is true."""
        return Rows(self.col[chosen[self.row]], np.concatenate([[0], np.cumsum(np.diff(self.at)[chosen])]))


def unpacked(column: pa.Array) -> Rows:
    """A column of packed bucket numbers, two bytes each."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return Rows(whole.view("<u2").astype(np.int64), (at - at[0]) // 2)


def views(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_view, meta_view): both views' bucket numbers, two bytes each."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b, data, offsets in chunks(batch.column(1)):
                both = text_view(data, offsets), meta_view(data, offsets, source[a:b], lang[a:b])
                packed = [pa.array([x.astype("<u2").tobytes() for x in v], pa.binary()) for v in both]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *packed], [key, "text_view", "meta_view"])

    return docs.select(key, "text", "source", "lang").mapInArrow(run, f"`{key}` {kind}, text_view binary, meta_view binary")


def _has_views(docs: DataFrame) -> bool:
    return {"text_view", "meta_view"} <= set(docs.columns)


def telling(n: np.ndarray, pos: np.ndarray, all_n: float, all_pos: float, most: int = 3_000, least: int = 4, sure: float = 12.0) -> np.ndarray:
    """The buckets that tell the classes apart best, by chi-squared, among those of at least ``least`` rows.

    ``n`` and ``pos`` are each bucket's rows and those of class 1. ``sure`` is about the largest value that chance
    gives among so many buckets.
    """
    expected = n * all_pos / max(1.0, all_n)
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - all_pos / max(1.0, all_n)) * np.maximum(1e-9, 1 - n / (all_n + 1)), 1e-9)
    chi[n < least] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] > sure])


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        return np.bincount(rows.row, self.weights[rows.col], len(rows)) + self.bias

    def calibrated(self, rows: Rows) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def start(taught: np.ndarray | None, rows: Rows, y: np.ndarray, dims: int) -> Linear:
    """Weights from pseudo-labels: log ratios of their counts, scaled to fit the labelled rows; zero without any.

    ``taught`` has per class (0, 1) the counts of all buckets and, last, of the rows.
    """
    out = Linear(np.zeros(dims), 0.0)
    if taught is None or not taught[:, -1].all():
        return out
    n, size = taught[:, :-1].astype(float), taught[:, -1].astype(float)
    chosen = telling(n.sum(0), n[1], size.sum(), size[1])
    share = (n[:, chosen] + 1) / (size[:, None] + 2)
    out.weights[chosen] = np.log(share[1]) - np.log(share[0])
    calibrate(out, rows, y)
    return Linear(out.slope * out.weights, out.shift)


def fit_linear(rows: Rows, y: np.ndarray, dims: int, taught: np.ndarray | None = None, steps: int = 120, ridge: float = 2e-4) -> Linear:
    """Balanced logistic regression on the telling buckets, by gradient steps with per-weight rates from ``start``."""
    begin = start(taught, rows, y, dims)
    row, col = rows.row, rows.col
    chosen = telling(np.bincount(col, minlength=dims).astype(float), np.bincount(col, y[row], dims), float(len(y)), float(y.sum()))
    chosen = np.union1d(chosen, np.flatnonzero(begin.weights))
    place = np.full(dims, -1)
    place[chosen] = np.arange(len(chosen))
    row, col = row[place[col] >= 0], place[col[place[col] >= 0]]
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    first, b = begin.weights[chosen], begin.bias
    w = first.copy()
    seen, seen_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + b, -30, 30)))
        g = (p - y) * each
        d = np.bincount(col, g[row], len(chosen)) + ridge * (w - first)
        seen += d * d
        w -= 0.3 * d / np.sqrt(seen)
        seen_b += g.sum() ** 2
        b -= 0.3 * g.sum() / np.sqrt(seen_b)
    out = np.zeros(dims)
    out[chosen] = w
    return Linear(out, float(b))


def calibrate(model: Linear, rows: Rows, y: np.ndarray) -> None:
    """Platt's scaling by Newton steps."""
    z = np.clip(model.raw(rows), -60, 60)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, c = 0.1, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
    model.slope, model.shift = max(a, 0.0), c


@dataclass
class Judge:
    text: Linear | None
    meta: Linear | None
    bias: float = 0.0
    sides: tuple[float, float] = (1.0, 1.0)

    def score(self, t: Rows, m: Rows) -> np.ndarray:
        if self.text is None or self.meta is None:
            return np.full(len(t), 0.5)
        z = self.sides[0] * self.text.calibrated(t) + self.sides[1] * self.meta.calibrated(m) - self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(t: Rows, m: Rows, y: np.ndarray, taught: tuple[np.ndarray | None, np.ndarray | None] = (None, None)) -> Judge:
    """Both views' classifiers: a fifth of the rows is kept to calibrate them, another to combine them."""
    if len(set(y.tolist())) < 2:
        return Judge(None, None)
    fold = np.arange(len(y)) % 5
    parts = [fold > 1, fold == 0, fold == 1]
    if any(len(set(y[p].tolist())) < 2 for p in parts):
        parts = [np.ones(len(y), bool)] * 3
    own, at, last = parts
    a = fit_linear(t.of(own), y[own], TEXT_DIMS, taught[0])
    b = fit_linear(m.of(own), y[own], META_DIMS, taught[1])
    calibrate(a, t.of(at), y[at])
    calibrate(b, m.of(at), y[at])
    # one more logistic regression over the two calibrated scores sets how much each counts
    z = np.clip(np.stack([a.calibrated(t.of(last)), b.calibrated(m.of(last))], 1), -12, 12)
    s, c = np.array([0.5, 0.5]), 0.0
    for _ in range(500):
        g = 1 / (1 + np.exp(-np.clip(z @ s - c, -30, 30))) - y[last]
        s = np.maximum(0.0, s - 0.05 * ((g[:, None] * z).mean(0) + 1e-3 * (s - 0.5)))
        c += 0.05 * g.mean()
    return Judge(a, b, float(c), (float(s[0]), float(s[1])))


def exchange(free: DataFrame, judges: list[Judge]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per judge what the text and the metadata view are taught by the other over all of ``free``; see ``start``."""
    shared = free.sparkSession.sparkContext.broadcast(judges)  # TEXT_DIMS + META_DIMS doubles a target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(shared.value), 2, d + 1), np.int64) for d in (TEXT_DIMS, META_DIMS)]
        for batch in batches:
            both = unpacked(batch.column(0)), unpacked(batch.column(1))
            for k, judge in enumerate(shared.value):
                if judge.text is None or judge.meta is None:
                    continue
                for v, teacher in ((0, judge.meta.calibrated(both[1])), (1, judge.text.calibrated(both[0]))):
                    for label, sure in ((0, teacher < -SURE), (1, teacher > SURE)):
                        some, total = both[v].of(sure), sums[v][k, label]
                        total[:-1] += np.bincount(some.col, minlength=len(total) - 1)
                        total[-1] += len(some)
        for v, total in enumerate(sums):
            k, label, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (np.full(len(k), v), k, label, bucket)] + [pa.array(total[k, label, bucket])], ["v", "k", "label", "bucket", "n"])

    rows = free.select("text_view", "meta_view").mapInArrow(run, "v int, k int, label int, bucket int, n long")
    got = rows.groupBy("v", "k", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most as many rows as the models have buckets
    out = [np.zeros((len(judges), 2, d + 1), np.int64) for d in (TEXT_DIMS, META_DIMS)]
    for v, total in enumerate(out):
        g = got[got["v"] == v]
        total[g["k"].to_numpy(), g["label"].to_numpy(), g["bucket"].to_numpy()] = g["n"].to_numpy()
    return list(zip(*out, strict=True))


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), labelled: int = LABELLED, rounds: int = ROUNDS, key: str = "doc_id") -> dict[str, Judge]:
    """A judge for each target, from documents or their ``views``.

    At most ``labelled`` labelled rows are taken, those whose ids hash smallest; their bucket numbers go to the driver.
    All other documents, whose labels are not used, teach in every round. A target column that is missing has no judge's labels.
    """
    rows = labels.select(key, *(F.col(c).cast("int").alias(c) if c in labels.columns else F.lit(None).cast("int").alias(c) for c in targets))
    rows = rows.where(F.col(key).isNotNull() & F.coalesce(*targets).isNotNull())
    some = cut(rows.withColumn("h_", F.xxhash64(F.col(key), F.lit(3))).orderBy("h_", *targets).limit(labelled).drop("h_")).withColumnRenamed(key, "key_")
    some = F.broadcast(some)  # at most ``labelled`` rows
    seen = (docs if _has_views(docs) else cut(views(docs, key))).withColumnRenamed(key, "key_")
    got = seen.join(some, "key_").select("key_", "text_view", "meta_view", *targets).toPandas()
    got = got.assign(h_=[zlib.crc32(str(k).encode()) for k in got["key_"]]).sort_values(["h_", "key_", *targets], kind="stable").reset_index(drop=True)
    t, m = (unpacked(pa.array(got[c].tolist(), pa.binary())) for c in ("text_view", "meta_view"))
    have = [got[c].notna().to_numpy() for c in targets]
    data = [(t.of(h), m.of(h), got[c].to_numpy(float)[h]) for c, h in zip(targets, have, strict=True)]
    judges = [learn(*d) for d in data]
    for _ in range(rounds if any(j.text for j in judges) else 0):
        taught = exchange(seen.join(F.broadcast(some.select("key_")), "key_", "left_anti"), judges)
        judges = [learn(*d, x) for d, x in zip(data, taught, strict=True)]
    return dict(zip(targets, judges, strict=True))


def score(docs: DataFrame, judges: dict[str, Judge], key: str = "doc_id") -> DataFrame:
    """Per document or row of ``views``: key, score, toxic_score, quality, toxic (0 or 1) and keep."""
    shared = docs.sparkSession.sparkContext.broadcast(judges)  # TEXT_DIMS + META_DIMS doubles a target
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = unpacked(batch.column(1)), unpacked(batch.column(2))
            good, toxic = shared.value["quality"].score(t, m), shared.value["toxic"].score(t, m)
            yes, no = good >= 0.5, toxic > 0.5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(good), pa.array(toxic), pa.array(yes.astype(np.int32)), pa.array(no.astype(np.int32)), pa.array(yes & ~no)],
                [key, "score", "toxic_score", "quality", "toxic", "keep"],
            )

    seen = docs if _has_views(docs) else views(docs, key)
    return seen.select(key, "text_view", "meta_view").mapInArrow(run, f"`{key}` {kind}, score double, toxic_score double, quality int, toxic int, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fit and score in one go, with the views of the texts made once."""
    seen = cut(views(docs, key))
    return score(seen, fit(seen, labels, key=key), key)
