"""Long texts in chunks, and k-mer counts whose words travel in runs that share a minimizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer words than FEW travel in runs; MOST is the longest of these, so that a run of 31 bases holds at least five.
FEW, MOST = 10, 27
WORD = 31
CHUNK = 4096
ROWS = 512
#: Buckets, and tasks that count them, for each of the session's shuffle partitions.
BUCKETS = 8


def chunks(records: DataFrame, record: str, seq: str, size: int, lead: int, behind: int) -> DataFrame:
    """(record, block, first, lead, own, n, seq): texts of ``size`` letters with ``lead`` before and up to ``behind`` after them.

    Cut in one reading of a text; neither ``lead`` nor ``behind`` may exceed ``size``. Null and empty texts have no chunk.
    """
    if max(lead, behind) > size:
        raise ValueError("what stands beside a chunk must not be longer than a chunk")
    pieces = records.where(F.length(seq) > 0).select(F.col(record).cast("string").alias("record"), F.length(seq).cast("long").alias("n"), F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("p"))

    def row(text: Column, i: Column) -> Column:
        before = F.when(i > 0, F.substring(F.get("p", i - 1), size - lead + 1, lead)).otherwise("")
        after = F.coalesce(F.substring(F.get("p", i + 1), 1, behind), F.lit(""))
        return F.struct(i.cast("long").alias("block"), F.length(before).alias("lead"), F.length(text).alias("own"), F.concat(before, text, after).alias("seq"))

    out = pieces.select("record", "n", F.explode(F.transform("p", row)).alias("x"))
    return out.select("record", "x.block", (F.col("x.block") * size).alias("first"), "x.lead", "x.own", "n", "x.seq")


def windows(values: np.ndarray, length: int) -> np.ndarray:
    """Each place's next ``length`` values of two bits as one number (up to 31): doubled widths 1, 2, 4, ..., then joined."""
    total, width, parts = values, 1, []
    while width <= length:
        parts.append((width, total))
        total = (total[: max(total.size - width, 0)] << 2 * width) | total[width:]
        width *= 2
    out, have = np.zeros(max(values.size - length + 1, 0), np.int64), 0
    for width, part in reversed(parts):
        if length & width:
            out = (out << 2 * width) | part[have : have + out.size]
            have += width
    return out


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each place's next ``length`` values: two overlapping windows of a power of two."""
    width, now = 1, values
    while 2 * width <= length:
        now = np.minimum(now[: now.size - width], now[width:])
        width *= 2
    n = values.size - length + 1
    return np.minimum(now[:n], now[length - width : length - width + n])


def minimizers(codes: np.ndarray, k: int, m: int, both_strands: bool) -> np.ndarray:
    """Each k-mer's least hash of an m-mer; with both strands an m-mer and its reverse complement are one."""
    word = windows(codes, m)
    if both_strands:
        turned = windows(3 - codes[::-1], m)[::-1]
        word = np.minimum(word, turned)
    mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # spread, so that no run of one base comes first
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _least((mixed >> np.uint64(2)).astype(np.int64), k - m + 1)


def _runs(batches: Iterator[pa.RecordBatch], k: int, m: int, both_strands: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    code, odd = np.zeros(256, np.int64), np.ones(256, np.int64)
    code[list(b"ACGT")], odd[list(b"ACGT")] = range(4), 0
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            texts, own = batch.column("seq").to_pylist(), batch.column("own").to_numpy().astype(np.int64)
            flat = np.frombuffer(("-".join(texts) + "-" * WORD).encode("ascii", "replace"), np.uint8)
            steps = np.array([len(x) + 1 for x in texts])
            starts = np.cumsum(steps) - steps
            least = minimizers(code[flat], k, m, both_strands)
            strange = np.concatenate([[0], np.cumsum(odd[flat])])
            inside = np.zeros(flat.size + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + own, -1)
            ok = (strange[k:] - strange[:-k] == 0) & (np.cumsum(inside)[: least.size] > 0)
            at = np.flatnonzero(ok)
            if at.size == 0:
                continue
            new = np.ones(at.size, bool)
            new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
            head = np.flatnonzero(new)
            new |= (np.arange(at.size) - np.repeat(head, np.diff(np.append(head, at.size)))) % (WORD - k + 1) == 0
            head = np.flatnonzero(new)
            begin, size = at[head], np.diff(np.append(head, at.size)) + k - 1
            packed = windows(code[flat], WORD)[begin] >> 2 * (WORD - size) | np.int64(1) << 2 * size  # a 1 in front tells how long it is
            run, first, times = np.unique(packed, return_index=True, return_counts=True)
            bucket = least[begin[first]] % buckets
            order = np.lexsort((times, bucket))
            run, bucket, times = run[order], bucket[order], times[order]
            cut = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(times) != 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, run.size).astype(np.int32)), pa.array(run))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(times[cut].astype(np.int64)), lists], ["bucket", "times", "runs"])


def runs(records: DataFrame, seq: str, k: int, both_strands: bool = True) -> DataFrame:
    """(bucket, times, runs): packed stretches of A, C, G, T whose k-mers share a minimizer, by its bucket; equal ones of a
    batch are one that counts so many times, so a repeat of any length is a few runs a batch."""
    m, buckets = min(k - 1, 9 if k < 20 else 11), BUCKETS * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = chunks(records.withColumn("r_", F.lit("")), "r_", seq, CHUNK, 0, k - 1).select("own", "seq")
    return texts.mapInArrow(lambda batches: _runs(batches, k, m, both_strands, buckets), "bucket long, times long, runs array<long>")


def turned(df: DataFrame, word: str, k: int, name: str) -> DataFrame:
    """``df`` with the reverse complement of a packed word of k bases: its bits inverted, then pairs, fours, ... exchanged."""
    out = df.withColumn(name, F.expr(f"~{word}"))
    for shift, half in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        out = out.withColumn(name, F.expr(f"(shiftrightunsigned({name}, {shift}) & {half}L) | shiftleft({name} & {half}L, {shift})"))
    return out.withColumn(name, F.expr(f"shiftrightunsigned({name}, {64 - 2 * k})"))


def counts(records: DataFrame, seq: str, k: int, both_strands: bool = True) -> DataFrame:
    """(kmer, n): all k-mers of A, C, G, T, a k-mer and its reverse complement as one if ``both_strands``.

    For k from 2 to ``MOST``. A k-mer always has the same minimizer, so runs dealt by it are taken apart and counted as
    numbers where they arrive: one shuffle, of eight bytes a run. Null and empty texts have no k-mer.
    """
    if not 2 <= k <= MOST:
        raise ValueError(f"runs hold words of 2 to {MOST} bases, not {k}")
    # a number of tasks of its own: runs are dealt by their bytes otherwise, and hold up to 60 times as many in words
    tasks = BUCKETS * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs(records, seq, k, both_strands).repartition(tasks, "bucket").select("bucket", "times", F.explode("runs").alias("run"))
    size = dealt.withColumn("more", F.expr(f"cast((length(bin(run)) - 1) / 2 as int) - {k}"))
    words = size.select("bucket", "times", "run", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("i"))
    words = words.select("bucket", "times", F.expr(f"shiftright(run, 2 * i) & {(1 << 2 * k) - 1}L").alias("word"))
    if both_strands:
        words = turned(words, "word", k, "other").select("bucket", "times", F.least("word", "other").alias("word"))
    n = words.groupBy("bucket", "word").agg(F.sum("times").alias("n"))
    return n.select(F.translate(F.lpad(F.conv(F.col("word").cast("string"), 10, 4), k, "0"), "0123", "ACGT").alias("kmer"), "n")
