"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are, for each of its words (runs without white space, A-Z lower-cased), that word
with the up to four words before it. The sketch keeps the k smallest of their 64-bit hashes. Sketches
of parts merge into the sketch of the whole, and estimate resemblance, containment and the number of
distinct shingles. Null or a text without words has the empty sketch; two empty sketches resemble
each other fully, an empty and another one not at all. Equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import free_name, shuffle_partitions
from .vectors import SPACED, chunks, lower_ascii, mix, row_bounds, span_hashes, words

K = 128
WIDTH = 5


def shingle_hashes(h: np.ndarray, rows: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each word the hash of it and the up to ``width - 1`` words before it in its row."""
    total = np.zeros(len(h), np.uint64)
    for back in range(width):
        earlier = np.zeros(len(h), np.uint64)
        if back < len(h):
            same = rows[back:] == rows[: len(rows) - back]
            earlier[back:] = np.where(same, h[: len(h) - back], np.uint64(0))
        total = total * np.uint64(0x100000001B3) + earlier + np.uint64(back)
    return mix(total)


def sketches(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted k smallest distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b, data, offsets in chunks(column):
        data = lower_ascii(data)
        starts, ends, rows = words(data, offsets, SPACED)
        h = shingle_hashes(span_hashes(data, starts, ends), rows)
        at = row_bounds(rows, b - a)
        out += [smallest(h[at[i] : at[i + 1]], k) for i in range(b - a)]
    return out


def smallest(h: np.ndarray, k: int = K) -> np.ndarray:
    """The sorted k smallest distinct values."""
    few = h
    while len(few) > 4 * k:  # repeated hashes may hide behind a cut, so it is checked
        part = np.unique(np.partition(few, 2 * k)[: 2 * k])
        if len(part) >= k:
            return part[:k].copy()
        k_th = part[-1]
        rest = np.unique(few[few > k_th])
        return np.concatenate([part, rest])[:k]
    return np.unique(few)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's smallest k hashes that both sketches have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    n, m, r = distinct(a, k), distinct(b, k), resemblance(a, b, k)
    return float(min(1.0, r * (n + m) / ((1 + r) * n)))


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K) -> DataFrame:
    """``df`` with a sketch of each text and the estimated number of its distinct shingles.

    Rows are independent: repeated rows stay, an empty table gives an empty one.
    """
    name, count = free_name(df, name, "n_shingles_est")
    schema = df.select("*", F.lit("").alias(name), F.lit(0.0).alias(count)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sketches(batch.column(batch.schema.get_field_index(text)), k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([written(x) for x in got], pa.string()), pa.array([distinct(x, k) for x in got], pa.float64())],
                [*batch.schema.names, name, count],
            )

    return df.mapInArrow(run, schema)


def neighbour_fingerprints(docs: DataFrame, k: int = K, per_bucket: int = 2) -> DataFrame:
    """Sketches of each text and of its edit by the next document, in descending order of doc_id.

    The edit replaces the last floor(n / 2) code points by the first as many (or all) of the next
    document's; after the last comes the first. Null texts are empty, null ids come last, equal ids are
    ordered by text, and repeated rows give repeated results. A single row is its own next document.

    Ranges of ids (bounded by quantiles over all ids) are sorted apart, so texts are shuffled once; the
    rows with the first id of a range go to the range before it as well. Only the quantiles and one id a
    range pass through the driver.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    ids = docs.select(F.col("doc_id").cast("double").alias("x"), F.col("doc_id").cast("long").alias("doc_id"))
    probs = [i / (n * per_bucket) for i in range(1, n * per_bucket)]
    bounds = sorted(set(ids.where("x is not null").approxQuantile("x", probs, 0.2 / (n * per_bucket))))
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("double"), F.lit(float(lowest))).alias("x"))
    if bounds:
        rows = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="x", outputCol="b", handleInvalid="keep").transform(rows)
    rows = rows.withColumn("b", (-F.col("b")).cast("int") if bounds else F.lit(0))
    heads = {r["b"]: r["top"] for r in rows.groupBy("b").agg(F.max(F.coalesce("doc_id", F.lit(lowest))).alias("top")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    guest = F.lit(None).cast("int")
    for b in order:  # one branch a range
        guest = F.when((F.col("b") == b) & (F.coalesce("doc_id", F.lit(lowest)) == heads[b]), F.lit(before[b])).otherwise(guest) if len(order) <= 64 else guest
    if len(order) > 64:
        links = spark.createDataFrame([(heads[b], before[b]) for b in order], "top long, home int")
        rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(lowest))).join(F.broadcast(links), F.col("at") == F.col("top"), "left")
    else:
        rows = rows.withColumn("home", guest)
    both = F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("home").alias("b"), F.lit(1).alias("guest")))
    rows = rows.select("doc_id", "text", F.explode(F.filter(both, lambda x: x["b"].isNotNull())).alias("p"))
    rows = rows.select(F.col("p.b").alias("b"), F.col("p.guest").alias("guest"), "doc_id", "text")
    rows = rows.repartition(n, "b").sortWithinPartitions(F.asc("b"), F.asc("guest"), F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_est double, edited_contains double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []  # of the row before: bucket, guest, doc_id, text, sketch
        for batch in batches:
            texts, got = batch.column(3).to_pylist(), sketches(batch.column(3), k)
            pairs = []
            for b, g, i, t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, got, strict=True):
                if last and last[0] == b and not last[1]:
                    pairs.append((last[2], last[3], last[4], t or "", s))
                last = [b, g, i, t or "", s]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in pairs]
            new = sketches(pa.array(edited, pa.string()), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([len(p[1]) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([written(p[2]) for p in pairs], pa.string()),
                    pa.array([written(e) for e in new], pa.string()),
                    pa.array([resemblance(p[2], e, k) for p, e in zip(pairs, new, strict=True)], pa.float64()),
                    pa.array([resemblance(p[2], p[4], k) for p in pairs], pa.float64()),
                    pa.array([distinct(p[2], k) for p in pairs], pa.float64()),
                    pa.array([containment(p[2], e, k) for p, e in zip(pairs, new, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles_est", "edited_contains"],
            )

    return rows.mapInArrow(run, schema)
