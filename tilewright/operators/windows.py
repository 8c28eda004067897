"""Candidate windows: sliding, per segment, spliced, laid out in parts, numbered, masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import dna_kmers, reverse_complement


def window_structs(seq: Column, lower: int, upper: int | None = None, step: int = 1) -> Column:
    """Array of (start0, size, window): for each start in steps, each size from lower to upper that fits; none if too short."""
    if lower < 1 or step < 1 or (upper is not None and upper < lower):
        raise ValueError("lengths and step must be positive, and the least length not above the greatest")
    upper = lower if upper is None else upper
    n = F.length(seq)
    starts = F.sequence(F.lit(0), F.greatest(n - lower, F.lit(0)), F.lit(step))

    def sizes(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(lower), F.least(F.lit(upper), n - a)), lambda k: F.struct(a.alias("start0"), k.alias("size"), F.substring(seq, a + 1, k).alias("window")))

    return F.when(n >= lower, F.flatten(F.transform(starts, sizes)))


def sliding_windows(df: DataFrame, seq: str, lower: int, upper: int | None = None, step: int = 1) -> DataFrame:
    """``df`` times the windows of ``seq``: start0 (from 0), size, window."""
    return df.withColumn("w_", F.explode(window_structs(F.col(seq), lower, upper, step))).select(*df.columns, "w_.start0", "w_.size", "w_.window")


def number_within(df: DataFrame, group: list[str], order: list, name: str, first: int = 0) -> DataFrame:
    """Consecutive numbers within groups by a total order (extraction order, position, ...)."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1 + first).cast("long"))


def segment_windows(segments: DataFrame, gene: str, seq: str, start: str, lower: int, upper: int | None = None, step: int = 1, by: list[str] | None = None) -> DataFrame:
    """Windows of each segment with genome coordinates (1-based, inclusive) and probe_id ``gene_n``, n from 1 in extraction order."""
    out = sliding_windows(segments, seq, lower, upper, step)
    out = out.withColumns({"w_start": F.col(start) + F.col("start0"), "w_end": F.col(start) + F.col("start0") + F.col("size") - 1})
    out = number_within(out, [gene], [*(by or [start]), "start0", "size"], "n", 1)
    return out.withColumn("probe_id", F.concat_ws("_", F.col(gene), F.col("n")))


def spliced_windows(segments: DataFrame, gene: str, start: str, end: str, seq: str, name: str, lower: int, step: int = 1) -> DataFrame:
    """Windows of each gene's segments joined in order of their starts, with the names of the segments each one touches."""
    joined = segments.groupBy(gene).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(name).alias("name"), F.col(seq).alias("seq")))).alias("segs"))
    before = F.transform("segs", lambda _, i: F.aggregate(F.slice("segs", 1, i), F.lit(0), lambda n, x: n + F.length(x["seq"])))
    spans = F.transform(F.arrays_zip(F.col("segs").alias("g"), before.alias("a")), lambda z: F.struct(z["g"]["name"].alias("name"), z["a"].alias("a"), (z["a"] + F.length(z["g"]["seq"])).alias("b"), z["g"]["s"].alias("s")))
    out = joined.select(gene, F.array_join("segs.seq", "").alias("whole"), spans.alias("spans"))
    out = sliding_windows(out, "whole", lower, None, step)
    touched = F.filter("spans", lambda x: (x["a"] < F.col("start0") + F.col("size")) & (x["b"] > F.col("start0")))
    out = out.withColumn("t_", touched)
    last = F.element_at("t_", -1)
    return out.select(
        gene, "start0", "window", F.array_join("t_.name", ";").alias("segments"),
        (F.col("t_")[0]["s"] + F.col("start0") - F.col("t_")[0]["a"]).alias("start"), (last["s"] + F.col("start0") + F.col("size") - 1 - last["a"]).alias("end"),
    )


def kmer_rows(df: DataFrame, seq: str, k: int) -> DataFrame:
    """One row per k-mer of A, C, G, T."""
    return df.withColumn("kmer", F.explode(dna_kmers(seq, k)))


def compositions(bounds: dict[str, tuple[int, int]], lower: int, upper: int) -> list[tuple[int, ...]]:
    """All sizes of named parts within bounds whose sum lies in [lower, upper], in lexicographic order.

    Parts are added one at a time and sums that cannot be completed are pruned by what the rest can add.
    """
    lows, highs = zip(*bounds.values(), strict=True)
    done: list[tuple[int, ...]] = [()]
    for i in range(len(lows)):
        least, most = sum(lows[i + 1 :]), sum(highs[i + 1 :])
        done = [(*d, k) for d in done for k in range(lows[i], highs[i] + 1) if sum(d) + k + least <= upper and sum(d) + k + most >= lower]
    if not done:
        raise ValueError("no sizes of the parts satisfy the length")
    return done


def expand_layouts(df: DataFrame, seq: str, parts: dict[str, tuple[int, int]], lower: int, upper: int) -> DataFrame:
    """Each window once for each layout of its length: layout (number from 1 within a length), layout_id, and per part its bases and 1-based bounds."""
    spark = df.sparkSession
    counter: dict[int, int] = {}
    rows = []
    for sizes in compositions(parts, lower, upper):
        counter[sum(sizes)] = counter.get(sum(sizes), 0) + 1
        rows.append((sum(sizes), counter[sum(sizes)], "_".join(f"{n}:{k}" for n, k in zip(parts, sizes, strict=True)), *sizes))
    names = [f"k_{i}" for i in range(len(parts))]
    table = spark.createDataFrame(rows, "total int, layout int, layout_id string, " + ", ".join(f"{n} int" for n in names))
    out = df.join(F.broadcast(table), F.length(seq) == F.col("total"))  # as many rows as the protocol has layouts
    offset: Column = F.lit(0)
    cols = []
    for part, k in zip(parts, names, strict=True):
        cols += [F.substring(F.col(seq), offset + 1, F.col(k)).alias(f"{part}_seq"), (offset + 1).alias(f"{part}_start"), (offset + F.col(k)).alias(f"{part}_end")]
        offset = offset + F.col(k)
    return out.select(*df.columns, "layout", "layout_id", *cols)


def replicate(df: DataFrame, variants: DataFrame) -> DataFrame:
    """Every row with every variant of a codebook, whose rows are few."""
    return df.crossJoin(F.broadcast(variants))


def oriented(seq: Column, strand: Column) -> Column:
    """The sequence as it is read on its strand."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def unmasked(df: DataFrame, window: str) -> DataFrame:
    """Windows without soft-masked (lower-case) or unknown bases. Numbers given before keep their gaps."""
    return df.where(~F.col(window).rlike("[a-zN]"))
