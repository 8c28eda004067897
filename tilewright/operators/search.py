"""Similarity search: sites within some substitutions, k-mer counts, units of several oligos, annotated off-targets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.sequence import canonical, dna_kmers, hamming, packed_bases, packed_distance, reverse_complement, strip_version
from ..session import spread
from . import kmers


def seeds(length: int, mismatches: int) -> list[tuple[int, int]]:
    """(offset, size) of mismatches + 1 pieces of a query: one of them must match exactly."""
    n = mismatches + 1
    cuts = [i * length // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Bases that a seed is taken from: queries share the words of the longest of these that they reach; shorter ones have their own.
FRAMES = (20, 24, 32)
#: A frame's two pieces of mismatches + 2 must hold so many bases to be looked up as they are.
SELECTIVE = 10
LETTERS = "ACGTN"
#: Bases of a record that travel together before its places are made, at least.
CHUNK = 512


def frames(mismatches: int, frame: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(substitutions, [(offset, size), ...]) of each seed of a frame: one of them must fit within its substitutions.

    Of mismatches + 2 pieces two are free of them. Where two such pieces are too short to be selective, those of
    mismatches + 1 are taken: the two with fewest have one at most.
    """
    if mismatches == 0:
        return [(0, [(0, frame)])]
    close = 0 if 2 * frame >= SELECTIVE * (mismatches + 2) else 1
    pieces = seeds(frame, mismatches + 1 - close)
    return [(close, list(pair)) for pair in combinations(pieces, 2)]


def _framed(word: str, mismatches: int, sizes: list[int], fits: Callable[[int], Column]) -> Column:
    """Rows of (frame, pair, close, seed): of each frame that fits the seeds of a word's first bases."""
    none, out = F.array().cast("array<struct<frame:int,pair:int,close:int,seed:string>>"), []
    for k in sizes:
        pairs = [F.struct(F.lit(k).alias("frame"), F.lit(i).alias("pair"), F.lit(close).alias("close"), F.concat(*[F.substring(word, a + 1, n) for a, n in pieces]).alias("seed")) for i, (close, pieces) in enumerate(frames(mismatches, k))]
        out.append(F.when(fits(k), F.array(*pairs)).otherwise(none))
    return F.explode(F.concat(*out))


def _near(seed: str) -> Column:
    """A seed and all words of one substitution."""
    places = F.sequence(F.lit(1), F.length(seed))
    changed = F.transform(places, lambda i: F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.concat(F.substring(F.col(seed), F.lit(1), i - 1), x, F.substring(F.col(seed), i + 1, F.length(seed)))))
    return F.array_distinct(F.concat(F.array(seed), F.flatten(changed)))


def mismatch_sites(queries: DataFrame, records: DataFrame, query: str, record: str, seq: str, mismatches: int, strand: str = "sense") -> DataFrame:
    """(query, strand, record, start0, mismatches): all end-to-end sites with at most so many substitutions.

    By the pigeonhole: the first bases of a query, its frame, are cut into pieces, and each pair of pieces that may fit
    (``frames``) is joined by equality with the same pair of every place of the records; whole sites are then compared.
    A pair holds 10 bases or more of queries of 15 (one or two mismatches), so chance meetings stay few, and both sides
    grow with their own rows. Seeds, and words of up to 31 bases, travel as numbers that are made once a row and compared as such. A small job finds the lengths first. Letters other than A, C, G, T are one letter in a seed,
    and themselves in the comparison. strand: sense, antisense or both.
    A query of no more bases than mismatches has a piece of none, which fits anywhere: those are laid on every place.
    """
    strands = {"sense": ["+"], "antisense": ["-"], "both": ["+", "-"]}[strand]
    own = spread(queries.select(F.col(query).alias("query")), "query").distinct()
    q = own.select("query", F.explode(F.array(*[F.struct(F.lit(s).alias("strand"), (F.col("query") if s == "+" else reverse_complement("query")).alias("word")) for s in strands])).alias("x"))
    q = q.select("query", "x.strand", "x.word")
    size = F.length("word")
    short = _short_sites(q.where(size <= mismatches), records, record, seq)
    frame = F.length("query")
    for low, high in reversed(list(zip(FRAMES, [*FRAMES[1:], None], strict=True))):
        frame = F.when((F.length("query") >= low) & ((F.length("query") < high) if high else F.lit(True)), low).otherwise(frame)
    shape = own.where(F.length("query") > mismatches).groupBy(frame.alias("frame")).agg(F.max(F.length("query")).alias("reach")).collect()  # at most 22 rows
    if not shape:
        return short
    reach = max(x["reach"] for x in shape)
    sizes = sorted(x["frame"] for x in shape)

    q = q.where(size > mismatches).withColumn("alike", _alike("word")).withColumn("key", _framed("alike", mismatches, sizes, lambda k: frame == k))
    q = q.select("query", "strand", F.length("word").alias("size"), packed_bases("word").alias("packed"), "key.*").withColumn("query", F.when(F.col("packed").isNull(), F.col("query")))
    q = q.withColumn("seed", F.explode(F.when(F.col("close") > 0, _near("seed")).otherwise(F.array("seed")))).withColumn("seed", _keyed()).select("query", "strand", "size", "packed", "seed")
    kind = records.select(record).schema[record].dataType
    texts = kmers.chunks(spread(records.select(F.col(record), F.col(seq).alias("seq_")), record), record, "seq_", max(CHUNK, reach), 0, reach - 1)
    r = texts.where(F.length("seq") >= sizes[0]).withColumn("all", _alike("seq")).withColumn("at", F.explode(F.sequence(F.lit(0), F.least("own", F.length("seq") - sizes[0] + 1) - 1)))
    r = r.select(F.col("record").cast(kind).alias("record"), (F.col("first") + F.col("at")).cast("int").alias("start0"), F.substring(F.col("seq"), F.col("at") + 1, F.lit(reach)).alias("there"), F.substring(F.col("all"), F.col("at") + 1, F.lit(sizes[-1])).alias("alike"))
    r = r.select("record", "start0", "there", F.length("there").alias("n"), packed_bases("there").alias("bases"), _framed("alike", mismatches, sizes, lambda k: F.length("alike") >= k).alias("key")).withColumn("there", F.when(F.col("bases").isNull(), F.col("there")))
    r = r.select("record", "start0", "there", "n", "bases", "key.frame", "key.pair", "key.seed").withColumn("seed", _keyed()).drop("frame", "pair")
    both = q.hint("merge").join(r, "seed").where(F.col("n") >= F.col("size"))
    plain = F.col("packed").isNotNull() & F.col("bases").isNotNull()
    near = packed_distance(F.col("packed"), F.expr("shiftrightunsigned(bases, 2 * (n - size))"))
    word = F.coalesce(F.when(F.col("strand") == "+", F.col("query")).otherwise(reverse_complement("query")), _unpacked("packed", "size"))
    there = F.substring(F.coalesce("there", _unpacked("bases", "n")), F.lit(1), F.col("size"))
    found = both.withColumn("mismatches", F.when(plain, near).otherwise(_differing(word, there))).where(F.col("mismatches") <= mismatches)
    found = found.select("query", "strand", "size", "packed", "record", "start0", "mismatches").distinct()
    whole = F.when(F.col("strand") == "+", _unpacked("packed", "size")).otherwise(reverse_complement(_unpacked("packed", "size")))
    return found.select(F.coalesce("query", whole).alias("query"), "strand", "record", "start0", "mismatches").unionByName(short)


def _keyed() -> Column:
    """A frame's seed as a number; two that share one are told apart when whole sites are compared."""
    return F.xxhash64("frame", "pair", "seed")


def _unpacked(packed: str, size: str) -> Column:
    """The bases of a number of ``packed_bases``."""
    return F.translate(F.lpad(F.conv(F.col(packed).cast("string"), 10, 4), F.col(size), F.lit("0")), "0123", "ACGT")


def _alike(text: str) -> Column:
    return F.regexp_replace(text, "[^ACGT]", "N")


def _differing(a: str, b: str) -> Column:
    return F.coalesce(packed_distance(packed_bases(a), packed_bases(b)), hamming(a, b))


def _short_sites(q: DataFrame, records: DataFrame, record: str, seq: str) -> DataFrame:
    """(query, strand, record, start0, mismatches) of all places of words no longer than the mismatches allowed: joined by
    their length, of which there are few, with the records' words."""
    r = records.select(F.col(record).alias("record"), F.col(seq).alias("seq")).join(F.broadcast(q.select(F.length("word").alias("k")).distinct()), F.length("seq") >= F.col("k"))
    r = r.where("k > 0").withColumn("start0", F.explode(F.sequence(F.lit(0), F.length("seq") - F.col("k")))).select("record", "start0", "k", F.substring(F.col("seq"), F.col("start0") + 1, F.col("k")).alias("there"))
    return q.join(r, F.length("word") == F.col("k")).select("query", "strand", "record", "start0", hamming(F.col("word"), F.col("there")).alias("mismatches"))


def _ungapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, record, start0, score): the best run of a query laid on the bases there, all rows of a batch at once; what is missing there differs."""
    for batch in batches:
        texts = [batch.column(c).to_pylist() for c in ("query", "there")]
        n = max(map(len, texts[0]), default=0)
        word, there = (np.frombuffer("".join(x.ljust(n, blank) for x in side).encode("utf-32-le"), "<u4").reshape(len(side), n) for side, blank in zip(texts, "\0\1", strict=True))
        gain = np.where(word == there, 2, -6).astype(np.int32)
        now, best = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
        for i in range(n):
            now = np.maximum(now + gain[:, i], 0)
            best = np.maximum(best, now)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "record", "start0")), pa.array(best)], ["query", "record", "start0", "score"])


def heuristic_sites(queries: DataFrame, records: DataFrame, query: str, record: str, seq: str, seed: int = 12, most: int = 100) -> DataFrame:
    """An approximation of a local aligner: exact seeds, ungapped extension over the query, score 2 a match and -6 a mismatch.

    At least 20 + 8 ln(length) is asked, and the best ``most`` sites a query are kept. Gaps are not found; ``alignment`` does.
    """
    q = spread(queries.select(F.col(query).alias("query")), "query").distinct()
    q = q.select("query", F.explode(F.filter(F.sequence(F.lit(1), F.length("query"), F.lit(4)), lambda i: i + seed - 1 <= F.length("query"))).alias("at")).withColumn("seed", F.substring(F.col("query"), F.col("at"), F.lit(seed)))
    r = spread(records.select(F.col(record).alias("record"), F.col(seq).alias("seq")), "record").where(F.length("seq") >= seed)
    r = r.withColumn("s", F.explode(F.sequence(F.lit(1), F.length("seq") - seed + 1))).withColumn("seed", F.substring(F.col("seq"), F.col("s"), F.lit(seed)))
    both = q.hint("merge").join(r, "seed").withColumn("start0", F.col("s") - F.col("at")).where("start0 >= 0")
    both = both.select("query", "record", "start0", F.substring(F.col("seq"), F.col("start0") + 1, F.length("query")).alias("there")).distinct()
    kind = records.schema[record].dataType.simpleString()
    scored = both.mapInArrow(_ungapped, f"query string, record {kind}, start0 int, score int").where(F.col("score") >= 20 + 8 * F.log(F.length("query")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "record", "start0"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "record", "start0", "score")


def gene_of(record: Column) -> Column:
    """The gene of a record ``gene_transcript``."""
    return F.substring_index(record, "_", 1)


def fewest_mismatches(hits: DataFrame) -> DataFrame:
    """(query, gene, mismatches): the closest site of each gene."""
    return hits.groupBy("query", gene_of(F.col("record")).alias("gene")).agg(F.min("mismatches").alias("mismatches"))


def site_lists(hits: DataFrame) -> DataFrame:
    """(query, mapped_sites, mapped_sites_num), sites in order of record and start; without end0 a site is as long as its query."""
    end = F.col("end0") if "end0" in hits.columns else (F.col("start0") + F.length("query")).alias("end0")
    sites = F.array_sort(F.collect_list(F.struct("record", "start0", end)))
    return hits.groupBy("query").agg(sites.alias("mapped_sites"), F.count("*").alias("mapped_sites_num"))


def kmer_table(records: DataFrame, seq: str, k: int, both_strands: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(kmer, n) over all records; with ``only`` (kmer), the others are dropped before they are counted.

    Words of up to ``kmers.FEW`` bases are so few that each task counts them before they are moved; those of up to
    ``kmers.MOST`` travel in packed runs; longer ones, and what ``only`` leaves, are moved one by one.
    """
    if only is None and kmers.FEW < k <= kmers.MOST:
        return kmers.counts(records, seq, k, both_strands)
    words = records.select(F.explode(dna_kmers(seq, k)).alias("kmer"))
    if both_strands:
        words = words.select(canonical("kmer").alias("kmer"))
    if only is not None:
        words = words.join(only, "kmer", "left_semi")
    return words.groupBy("kmer").agg(F.count("*").alias("n"))


def max_kmer_count(queries: DataFrame, records: DataFrame, query: str, seq: str, k: int, both_strands: bool = True, restrict: bool = False) -> DataFrame:
    """``queries`` with kmer_count: the largest count among the query's k-mers; 0 if shorter than k."""
    name = canonical("kmer") if both_strands else F.col("kmer")
    mine = queries.select(F.col(query)).distinct().withColumn("kmer", F.explode(dna_kmers(query, k))).withColumn("kmer", name)
    counts = kmer_table(records, seq, k, both_strands, mine.select("kmer").distinct() if restrict else None)
    most = mine.join(counts, "kmer", "left").groupBy(query).agg(F.max(F.coalesce("n", F.lit(0))).alias("kmer_count"))
    return queries.join(most, query, "left").withColumn("kmer_count", F.coalesce("kmer_count", F.lit(0)))


def units(members: DataFrame, hits: DataFrame, unit: str, query: str, gap: int | None = None, same_strand: bool = True) -> DataFrame:
    """(unit, record, mismatches): records that every oligo of a unit hits; the worst oligo's mismatches at the best place.

    With a gap, units of two oligos must lie apart without overlap, at most so far, on one strand.
    """
    strands = ["strand"] if same_strand else []
    cols = [unit, "record", *strands]
    need = members.groupBy(unit).agg(F.countDistinct(query).alias("need"))
    sized = members.select(unit, F.col(query).alias("q_")).distinct().join(need.hint("merge"), unit)
    h = sized.hint("merge").join(hits, F.col("q_") == hits["query"]).select(*cols, "query", "start0", "mismatches", "need").repartition(*cols)  # dealt once for all steps below
    if gap is None:
        best = h.groupBy(*cols, "query").agg(F.min("mismatches").alias("m"), F.first("need").alias("need"))
        whole = best.groupBy(*cols).agg(F.count("*").alias("have"), F.max("m").alias("mismatches"), F.first("need").alias("need")).where("have = need")
        return whole.groupBy(unit, "record").agg(F.min("mismatches").alias("mismatches"))
    a = h.select(*cols, F.col("query").alias("qa"), F.col("start0").alias("a0"), (F.col("start0") + F.length("query")).alias("a1"), F.col("mismatches").alias("ma"))
    b = h.select(*cols, F.col("query").alias("qb"), F.col("start0").alias("b0"), (F.col("start0") + F.length("query")).alias("b1"), F.col("mismatches").alias("mb"))
    near = a.hint("merge").join(b, cols).where((F.col("qa") < F.col("qb")) & (((F.col("b0") >= F.col("a1")) & (F.col("b0") - F.col("a1") <= gap)) | ((F.col("a0") >= F.col("b1")) & (F.col("a0") - F.col("b1") <= gap))))
    return near.groupBy(unit, "record").agg(F.min(F.greatest("ma", "mb")).alias("mismatches"))


def gene_labels(genes: DataFrame, key: str, name: str) -> DataFrame:
    """(key, label): the name, or ``name(key)`` where several keys share it; the key where there is no name."""
    n = F.count("*").over(Window.partitionBy(name))
    return genes.withColumn("n_", n).select(key, F.when(F.col(name).isNull(), F.col(key)).when(F.col("n_") > 1, F.concat(name, F.lit("("), F.col(key), F.lit(")"))).otherwise(F.col(name)).alias("label"))


def listed(items: Column) -> Column:
    """``label:mismatches`` in order of mismatches and label, from an array of (mismatches, label)."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(x["label"], F.lit(":"), x["mismatches"].cast("string"))), ", ")


def expression_values(wanted: DataFrame, table: DataFrame, key: str, name: str, id_: str, value: str) -> DataFrame:
    """``wanted`` with value: by id without version, then by name; of duplicates the largest."""
    v = table.groupBy(F.regexp_replace(id_, r"\.\d+$", "").alias("id_")).agg(F.max(value).alias("v_"))
    by_key = wanted.join(v.withColumnRenamed("v_", "vk_"), F.regexp_replace(key, r"\.\d+$", "") == F.col("id_"), "left").drop("id_")
    return by_key.join(v.withColumnRenamed("v_", "vn_"), F.col(name) == F.col("id_"), "left").withColumn("value", F.coalesce("vk_", "vn_")).drop("id_", "vk_", "vn_")


def transcript_values(hits: DataFrame, expression: DataFrame) -> DataFrame:
    """(query, gene, value, missing, hit_transcripts): each gene by the transcripts of it that a sequence hits.

    hits: (query, record) with records named ``gene_transcript``; expression: (id, value) of transcripts. An id listed twice
    has its largest value; ids and values that are null or blank are left out. A transcript is found by its id, else by its
    id without version where only one listed id has that. value: the sum over those found, null where none is; missing: the
    others, in order; hit_transcripts: (transcript, value) of all, in order. A site's count on a transcript does not matter.
    """
    listed_ids = expression.select(F.trim("id").alias("id_"), F.col("value").cast("double").alias("v")).where((F.col("id_") != "") & F.col("v").isNotNull() & ~F.isnan("v")).groupBy("id_").agg(F.max("v").alias("exact_"))
    bare = listed_ids.groupBy(strip_version(F.col("id_")).alias("base_")).agg(F.count("*").alias("n_"), F.max("exact_").alias("only_")).where("n_ = 1").drop("n_")
    h = hits.select("query", "record").distinct().select("query", gene_of(F.col("record")).alias("gene"), F.expr("substr(record, locate('_', record) + 1)").alias("transcript"))
    h = h.join(listed_ids, F.col("transcript") == F.col("id_"), "left").drop("id_").withColumn("key_", strip_version(F.col("transcript")))
    h = h.join(bare, F.col("key_") == F.col("base_"), "left").withColumn("value", F.coalesce("exact_", "only_"))
    each = F.array_sort(F.collect_list(F.struct("transcript", "value")))  # as many as a gene has transcripts
    out = h.groupBy("query", "gene").agg(F.sum("value").alias("value"), each.alias("hit_transcripts"))
    return out.select("query", "gene", "value", F.transform(F.filter("hit_transcripts", lambda x: x["value"].isNull()), lambda x: x["transcript"]).alias("missing"), "hit_transcripts")


def annotate(hits: DataFrame, targets: DataFrame, labels: DataFrame | None, expression: DataFrame | None = None, least: float = 0.0, fraction: float = 0.0, absent: str = "count", copies: DataFrame | None = None) -> DataFrame:
    """Per (query, target): how many genes count, and the lists of off-targets, unexpressed genes and copies.

    hits: (query, gene, mismatches); targets: (query, target, gene) with all genes that are the target, which counts
    once; labels: (gene, label), or none where a gene is its own label; expression: (gene, value); copies: (target, gene). A gene counts unless it is a copy of
    the target or its value is below max(least, fraction x the target's value); genes the table lacks follow ``absent``.
    """
    own = targets.select("query", "target").distinct()
    # a plan takes queries for few by the table that they are made of, and would have the driver broadcast them
    h = hits.hint("merge").join(own, "query").join(targets.withColumn("own_", F.lit(True)).hint("merge"), ["query", "target", "gene"], "left")
    h = h.join(labels.hint("merge"), "gene", "left").withColumn("label", F.coalesce("label", "gene")) if labels is not None else h.withColumn("label", F.col("gene"))
    if expression is not None:
        of_target = targets.join(expression, "gene").groupBy("target").agg(F.max("value").alias("tv_"))
        h = h.join(expression, "gene", "left").join(of_target, "target", "left")
        level = F.greatest(F.lit(float(least)), F.coalesce(F.col("tv_"), F.lit(0.0)) * fraction)
        h = h.withColumn("low_", F.when(F.col("value").isNull(), F.lit(absent == "ignore")).otherwise(F.col("value") < level))
    else:
        h = h.withColumn("low_", F.lit(False))
    h = h.join(copies.withColumn("copy_", F.lit(True)), ["target", "gene"], "left") if copies is not None else h.withColumn("copy_", F.lit(None).cast("boolean"))
    kind = F.when(F.col("own_"), "own").when(F.col("copy_"), "copy").when(F.col("low_"), "low").otherwise("off")
    h = h.withColumn("kind_", kind)
    item = F.struct("mismatches", "label")

    def names(k: str) -> Column:
        return listed(F.collect_list(F.when(F.col("kind_") == k, item)))

    count = F.max((F.col("kind_") == "own").cast("int")) + F.sum((F.col("kind_") == "off").cast("int"))
    return h.groupBy("query", "target").agg(count.cast("long").alias("mapped_genes"), names("off").alias("off_targets"), names("low").alias("unexpressed"), names("copy").alias("copies"))


#: The longest words of which most pairs of texts share some by chance: so many of them fit a table that a task holds.
DENSE = 8
#: Words of a block of records and of a block of targets that meet in one cell, about; and rows that leave it at once.
BLOCK, FACING, OUT_ROWS = 1 << 21, 1 << 21, 1 << 17
#: Words of up to ``DENSE`` bases less this travel in two bytes.
HALF = 1 << 15


def _postings(pieces: list[pa.RecordBatch], k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's record names, the places of records by word, and where each word's places begin."""
    names = pa.concat_arrays([p.column("record") for p in pieces])
    lists = pa.concat_arrays([p.column("words") for p in pieces])
    row = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32) + HALF
    by_word = np.argsort(words, kind="stable")
    return names, row[by_word], np.searchsorted(words[by_word], np.arange(4**k + 1))


def _met(piece: pa.RecordBatch, names: pa.Array, places: np.ndarray, begins: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Each target's records with at least ``least`` words in common: its words' places are counted by record."""
    lists, who = piece.column("words"), piece.column("target")
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32) + HALF, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    hits, shares, rows, made = [], [], [], 0

    def batch() -> pa.RecordBatch:
        target = who.take(pa.array(np.repeat(rows, [h.size for h in hits])))
        return pa.RecordBatch.from_arrays([target, names.take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(shares))], ["target", "record", "share"])

    for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        words = flat[start:end]
        n = np.bincount(np.concatenate([places[a:b] for a, b in zip(begins[words], begins[words + 1], strict=True)]), minlength=len(names))
        hit = np.flatnonzero(n >= least)
        if hit.size:
            hits.append(hit)
            shares.append(n[hit] / words.size)
            rows.append(i)
            made += hit.size
        if made >= OUT_ROWS:
            yield batch()
            hits, shares, rows, made = [], [], [], 0
    if made:
        yield batch()


def _met_cells(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows by cell, records before targets: a block of records is held, targets pass by."""
    cell, block, index = None, [], None
    for batch in batches:
        mark = 2 * batch.column("cell").to_numpy() + batch.column("side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(mark)) + 1), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if start == end:
                continue
            if mark[start] // 2 != cell:
                cell, block, index = mark[start] // 2, [], None
            piece = batch.slice(start, end - start)
            if mark[start] % 2 == 0:
                block.append(piece)
            elif block:
                index = index or _postings(block, k)
                yield from _met(piece, *index, least)


def shared_kmers(targets: DataFrame, records: DataFrame, target: str, t_seq: str, record: str, r_seq: str, k: int, least: int = 1) -> DataFrame:
    """(target, record, share): the part of a target's distinct k-mers that a record holds, where it holds at least ``least``.

    Up to ``DENSE`` bases most pairs share some word by chance, so no join by words narrows them: each block of records
    meets each block of targets in a cell of its own, where the records of a target's words are counted. Only pairs with
    enough words leave it. A cell holds one block of records as numbers, whatever the tables' sizes. Longer words are joined.
    """
    if k > DENSE:
        t = targets.select(F.col(target).alias("target"), F.explode(dna_kmers(t_seq, k)).alias("kmer")).distinct()
        r = records.select(F.col(record).alias("record"), F.explode(dna_kmers(r_seq, k)).alias("kmer")).distinct()
        size = t.groupBy("target").agg(F.count("*").alias("size"))
        both = t.join(r, "kmer").groupBy("target", "record").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return both.join(size, "target").select("target", "record", (F.col("n") / F.col("size")).alias("share"))

    def words(df: DataFrame, name: str, seq: str) -> DataFrame:
        one = spread(df.select(F.col(name).alias("name"), F.col(seq).alias("seq")), "name").select("name", F.explode(dna_kmers("seq", k)).alias("kmer"))
        return one.groupBy("name").agg(F.collect_set((packed_bases("kmer") - HALF).cast("short")).alias("words"))

    def blocks(df: DataFrame, seq: str, size: int) -> int:
        total = df.agg(F.sum(F.greatest(F.length(seq) - k + 1, F.lit(0)).cast("long"))).first()[0] or 0
        return -(-total // size) or 1

    high, wide = blocks(records, r_seq, BLOCK), blocks(targets, t_seq, FACING)
    wide = max(wide, -(-int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")) // high))
    types = {"target": targets.select(F.col(target)).schema[0].dataType, "record": records.select(F.col(record)).schema[0].dataType}
    mine = lambda n: F.pmod(F.xxhash64("name"), F.lit(n))
    r = words(records, record, r_seq).select((mine(high) * wide).alias("row"), F.lit(0).alias("side"), F.lit(None).cast(types["target"]).alias("target"), F.col("name").alias("record"), "words")
    r = r.withColumn("cell", F.explode(F.sequence(F.col("row"), F.col("row") + wide - 1)))
    t = words(targets, target, t_seq).where("name is not null").select(mine(wide).alias("row"), F.lit(1).alias("side"), F.col("name").alias("target"), F.lit(None).cast(types["record"]).alias("record"), "words")
    t = t.withColumn("cell", F.explode(F.sequence(F.col("row"), F.col("row") + (high - 1) * wide, F.lit(wide).cast("long"))))
    columns = ["cell", "side", "target", "record", "words"]
    cells = r.select(columns).unionAll(t.select(columns)).repartition(high * wide, "cell").sortWithinPartitions("cell", "side")
    out = StructType([StructField("target", types["target"]), StructField("record", types["record"]), StructField("share", DoubleType())])
    return cells.mapInArrow(lambda batches: _met_cells(batches, k, least), out)


def overlay(windows: DataFrame, target: str, start: str, window: str) -> DataFrame:
    """(target, seq): windows laid over each other by 1-based start; places that none covers are N.

    Each place's base comes from the covering window with the smallest start.
    """
    bases = windows.select(target, F.col(start).alias("s_"), F.posexplode(F.split(window, "")).alias("i_", "base")).where("base <> ''")
    one = bases.groupBy(target, (F.col("s_") + F.col("i_")).alias("at")).agg(F.min(F.struct("s_", "base")).alias("m_"))
    last = Window.partitionBy(target).orderBy("at")
    gap = F.repeat(F.lit("N"), (F.col("at") - F.coalesce(F.lag("at").over(last), F.col("at") - 1) - 1).cast("int"))
    parts = one.withColumn("piece", F.concat(gap, "m_.base"))
    return parts.groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("seq"))


def unknown_records(records: DataFrame, genes: DataFrame, record: str, gene: str) -> DataFrame:
    """Records whose gene is not known."""
    return records.join(genes, gene_of(F.col(record)) == genes[gene], "left_anti")


def exact_sites(queries: DataFrame, records: DataFrame, query: str, record: str, seq: str) -> DataFrame:
    """(site, n_sites): canonical queries and how many places hold them on either strand; a palindrome's place counts once."""
    q = queries.select(canonical(query).alias("site")).distinct()
    lengths = q.select(F.length("site").alias("k")).distinct()
    r = records.select(F.col(record).alias("record"), F.col(seq).alias("seq")).crossJoin(F.broadcast(lengths)).where(F.length("seq") >= F.col("k"))
    r = r.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("seq") - F.col("k") + 1)))
    r = r.select("record", "at", canonical(F.substring(F.col("seq"), F.col("at"), F.col("k"))).alias("site"))
    return q.join(r, "site", "left").groupBy("site").agg(F.count(F.when(F.col("record").isNotNull(), 1)).alias("n_sites"))
