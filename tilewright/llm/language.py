"""Language ID: nearest of several centroids per language, over normalised TF-IDF vectors of byte n-grams.

A text's letters are lower-cased (A-Z), other ASCII bytes become a space, and the hashed n-grams of the UTF-8
bytes are counted; log counts times inverse document frequencies, scaled to length one, are compared by cosine
with the centroids that spherical k-means finds for each language. A text farther from its nearest centroid than
the language's learned distance is rejected. Null or a text without a letter is ``und``, with score 0, and
rejected. Ties go to the language that sorts first. Without any learned language all texts are ``und``.

Rows are independent: repeated rows stay, an empty table gives an empty one. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import lean
from .vectors import byte_class, chunks, lower_ascii

DIMS = 1 << 13
#: The fit's bound: so many distinct labelled texts a language, those with the smallest hashes.
TRAIN_ROWS = 800
CENTROIDS = 4
#: The largest distance that any centroid accepts; one of fewer than FEW rows has no tail to learn from and takes it.
LARGEST = 0.995
FEW = 20
LETTER = byte_class([(0x61, 0x7A), (0x80, 0xFF)])
UNDEFINED = "und"


def _blank_others(data: np.ndarray) -> np.ndarray:
    data = lower_ascii(data)
    return np.where(LETTER[data], data, np.uint8(32))


def counts(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed 2-, 3- and 4-grams of each row, runs of blanks between words left out."""
    n = len(offsets) - 1
    b = _blank_others(data).astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets)).astype(np.int64)
    out = np.zeros(n * dims, np.float32)
    for size in (2, 3, 4):
        m = len(b) - size + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for j in range(size):
            h = h * np.uint32(257) + b[j : j + m]
        ok = (row[:m] == row[size - 1 :]) & ~((b[:m] == 32) & (b[1 : m + 1] == 32))
        h = (h * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - dims.bit_length() + 1)
        out += np.bincount(row[:m][ok] * dims + h[ok], minlength=n * dims)
    return out.reshape(n, dims)


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(size == 0, 1, size)


@dataclass
class LanguageModel:
    idf: np.ndarray
    names: list[str]  # of each centroid
    centroids: np.ndarray
    farthest: np.ndarray  # per centroid, the largest accepted distance
    sharpness: float = 30.0

    def predict(self, c: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, distance, rejected) of rows of counts. The score is the share of the language in a
        softmax over the best cosine of each language."""
        if not self.names:
            return [UNDEFINED] * len(c), np.zeros(len(c)), np.ones(len(c)), np.ones(len(c), bool)
        cosine = _weighted(c, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        langs = sorted(set(self.names))
        top = np.stack([cosine[:, [i for i, x in enumerate(self.names) if x == lang]].max(1) for lang in langs], 1)
        e = np.exp(self.sharpness * (top - top.max(1, keepdims=True)))
        p = e.max(1) / e.sum(1)
        distance = 1 - cosine[np.arange(len(c)), best]
        return [langs[i] for i in top.argmax(1)], np.clip(p, 0, 1), distance, distance > self.farthest[best]


def _rows_counts(column: pa.Array, dims: int = DIMS) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column, 400_000):
        for i in range(0, len(offsets) - 1, 256):
            o = offsets[i : i + 257]
            yield counts(data[o[0] : o[-1]], o - o[0], dims)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, centroids: int = CENTROIDS, quantile: float = 0.999, slack: float = 1.25) -> LanguageModel:
    """Learn from the rows with a language and a letter: document frequencies from all, centroids from a sample.

    The bound: of each language the ``rows`` distinct texts with the smallest hashes are taken. Copies of a text are one,
    with a weight that grows as the logarithm of their number, so that no text swamps a centroid; each counts once for
    the limits. The logarithms of their hashed counts go to the driver as sparse vectors of four bytes a value and stay
    sparse there.
    """
    some = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & has_letter(F.col("t"))).withColumn("x", F.xxhash64("t"))
    texts = some.groupBy("l", "x").agg(F.count("*").alias("n"))
    sizes = {r["l"]: r["n"] for r in texts.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel(np.zeros(DIMS), [], np.zeros((0, DIMS)), np.zeros(0))

    def below(edges: dict[str, int]) -> Column:
        take = F.lit(False)
        for k, edge in edges.items():
            take = take | ((F.col("l") == k) & (F.col("x") <= edge))
        return take

    # hashes are even over 64 bits: below twice the wanted share there are enough
    near = below({k: min((1 << 63) - 1, int((1 << 64) * (2 * rows + 100) / n) - (1 << 63)) for k, n in sizes.items()})
    copies: dict[str, dict[int, int]] = {k: {} for k in sizes}
    for r in texts.where(near).orderBy("x").collect():
        if len(copies[r["l"]]) < rows:
            copies[r["l"]][r["x"]] = r["n"]

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(DIMS + 1, np.int64), 0
        for batch in batches:
            for c in _rows_counts(batch.column(0)):
                n[:DIMS] += np.count_nonzero(c, axis=0)
                docs += len(c)
        n[DIMS] = docs
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, val = [], []
            for c in _rows_counts(batch.column(0)):
                for v in c:
                    nz = np.flatnonzero(v)
                    at.append(nz.astype("<u2").tobytes())
                    val.append(np.log1p(v[nz]).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(at, pa.binary()), pa.array(val, pa.binary())], ["l", "x", "at", "val"])

    seen = np.zeros(DIMS + 1, np.int64)
    for r in some.select("t").mapInArrow(lean(document_counts), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[r["at"]] = r["n"]
    drawn = some.where(below({k: max(x) for k, x in copies.items()})).dropDuplicates(["l", "x"])
    got = drawn.select("t", "l", "x").mapInArrow(lean(sparse), "l string, x long, at binary, val binary").toArrow().sort_by([("l", "ascending"), ("x", "ascending")])
    names = np.array(got.column("l").to_pylist(), object)

    def column(name: str, kind: str, rows: np.ndarray) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in got.column(name).take(pa.array(rows)).to_pylist()]

    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])).astype(np.float32) + 0.1
    labels, centres, limits = [], [], []
    for k in sorted(sizes):
        weight = 1 + np.log([float(copies[k][x]) for x in np.array(got.column("x"))[names == k].tolist()])
        at = column("at", "<u2", np.flatnonzero(names == k))
        row = np.repeat(np.arange(len(at), dtype=np.int32), [len(x) for x in at])
        n, at = len(at), np.concatenate(at)
        val = np.concatenate(column("val", "<f2", np.flatnonzero(names == k))).astype(np.float32) * idf[at]
        size = np.sqrt(np.bincount(row, val * val, n))
        val /= np.where(size == 0, 1, size)[row]
        c, cosine = _spherical_kmeans(row, at, val, weight.astype(np.float32), min(centroids, n))
        labels += [k] * len(c)
        centres += list(c)
        tail = slack * float(np.quantile(1 - cosine.max(1), quantile)) if n >= FEW else LARGEST
        limits += [min(LARGEST, tail)] * len(c)
    return LanguageModel(idf, labels, np.array(centres), np.array(limits))


def _spherical_kmeans(row: np.ndarray, at: np.ndarray, val: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Centres of length one, begun with evenly spaced rows, and the rows' cosines with them.

    The rows of length one are sparse: the values ``val`` stand in ``row`` at ``at``. Each counts by its weight.
    """
    n = len(weight)

    def centre(mine: np.ndarray) -> np.ndarray:
        c = np.bincount(at[mine], val[mine] * weight[row[mine]], DIMS).astype(np.float32)
        return c / (np.linalg.norm(c) or 1)

    def cosines() -> np.ndarray:
        return np.stack([np.bincount(row, val * x[at], n) for x in c], 1)

    c = [centre(row == i) for i in np.linspace(0, n - 1, k).astype(int)]
    for _ in range(rounds):
        own = cosines().argmax(1)
        c = [centre(own[row] == j) if (own == j).any() else x for j, x in enumerate(c)]
    return np.array(c), cosines()


def identify(df: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``df`` with <prefix>pred, <prefix>score, <prefix>distance and <prefix>rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    lettered = prefix + "lettered"
    names = [prefix + x for x in ("pred", "score", "distance", "rejected")]
    schema = df.select("*", *(F.lit(x).alias(n) for x, n in zip(("", 0.0, 0.0, True), names, strict=True))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ok = batch.column(batch.schema.get_field_index(lettered)).to_numpy(zero_copy_only=False)
            lang, score, far, out = [], [], [], []
            for c in _rows_counts(batch.column(batch.schema.get_field_index(text))):
                a, b, d, e = model.predict(c)
                lang += a
                score.append(b)
                far.append(d)
                out.append(e)
            score, far, out = (np.concatenate(x) if x else np.zeros(0) for x in (score, far, out))
            lang = [x if y else UNDEFINED for x, y in zip(lang, ok, strict=True)]
            kept = [i for i, n in enumerate(batch.schema.names) if n != lettered]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64()), pa.array(np.where(ok, far, 1.0), pa.float64()), pa.array(out.astype(bool) | ~ok.astype(bool))],
                [*(batch.schema.names[i] for i in kept), *names],
            )

    return df.withColumn(lettered, has_letter(F.col(text))).mapInArrow(lean(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
