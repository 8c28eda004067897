"""A seed index: every place of the records as packed bases, written once by seed and searched many times in place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import hamming, packed_bases, reverse_complement
from ..session import shared_folder, spread
from .kmers import chunks, windows
from .search import mismatch_sites

#: Bases that a packed number holds, and stand before a chunk's own.
WORD = 31
#: Letters other than A, C, G, T that a seed may hold, and the most substitutions a seed is looked up with.
ODD = 2
#: Bases of a chunk, and how far its text reaches beyond them, which is the longest query of the index.
CHUNK, REACH = 4096, 256
#: A seed that holds over a thousandth of all places (so at most a thousand seeds do) is dealt over so many salts.
HOT, SALTS = 1000, 32
#: Places of a bucket, which one task sorts: records of more bases get more buckets than the session has shuffle partitions.
BUCKET_PLACES = 500_000
ROWS = 512  # chunks packed at once: 2 MB of bases, 18 MB an array
PLACES = "seed long, record string, at long, n long, before long, odd_before long, here long, odd_here long"


@dataclass(frozen=True)
class SeedIndex:
    """places (bucketed by seed and salt), hot (seed), chunks (bucketed by record and block) and the records themselves."""

    places: DataFrame
    hot: DataFrame
    chunks: DataFrame
    records: DataFrame
    k: int
    name: str


def substitutions(k: int, most: int) -> tuple[list[int], list[int]]:
    """What to XOR a packed word of k bases with for all words within ``most`` substitutions, by their number; and how
    many there are with at most 0, 1, ... of them."""
    out, counts = [], []
    for d in range(most + 1):
        out += [sum(x << 2 * i for i, x in zip(where, what, strict=True)) for where in combinations(range(k), d) for what in product((1, 2, 3), repeat=d)]
        counts.append(len(out))
    return out, counts


def _packed_places(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    code, odd = np.zeros(256, np.int64), np.ones(256, np.int64)
    code[list(b"ACGT")], odd[list(b"ACGT")] = range(4), 0
    gap = "A" * WORD
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            texts = batch.column("seq").to_pylist()
            first, lead, own, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "lead", "own", "n"))
            flat = np.frombuffer((gap + gap.join(texts) + gap).encode("ascii", "replace"), np.uint8)
            steps = np.array([len(x) + WORD for x in texts])
            bases, strange = windows(code[flat], WORD), windows(odd[flat], WORD)
            row = np.repeat(np.arange(own.size), own)
            within = np.arange(row.size) - np.repeat(np.cumsum(own) - own, own)
            at, s = first[row] + within, (WORD + np.cumsum(steps) - steps + lead)[row] + within
            seed_odd = strange[s] >> 2 * (WORD - k)
            ok = (at + k <= n[row]) & (np.bitwise_count(seed_odd) <= ODD)
            row, at, s = row[ok], at[ok], s[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bases[s] >> 2 * (WORD - k)), batch.column("record").take(pa.array(row)), pa.array(at), pa.array(n[row]), pa.array(bases[s - WORD]), pa.array(strange[s - WORD]), pa.array(bases[s]), pa.array(strange[s])],
                ["seed", "record", "at", "n", "before", "odd_before", "here", "odd_here"],
            )


def write_index(records: DataFrame, record: str, seq: str, k: int = 10, buckets: int | None = None, split_above: int = 100_000) -> SeedIndex:
    """The index of the records' words of ``k`` bases (4 to 15), as tables in the folder that driver and executors share.

    A place is some 60 bytes whatever the queries will be, so it grows with the bases. ``buckets`` should leave a bucket
    that a task can read (left out: the session's shuffle partitions, or more where a bucket would hold over
    ``BUCKET_PLACES``, so that a task's memory does not grow with the records). A seed with more than ``split_above`` places and
    over a thousandth of all is salted, so that no bucket holds a common word whole. Words with more than two letters
    other than A, C, G, T, as in long gaps, are left out; no search that the index answers can hit them. Records that are
    null or empty have no place; names are taken as text. Tables stay until ``drop``; the files are the folder's.
    """
    if not 4 <= k <= 15:
        raise ValueError(f"seeds must have 4 to 15 bases, not {k}")
    spark = records.sparkSession
    if not buckets:
        bases = records.agg(F.sum(F.length(seq))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bases // BUCKET_PLACES))
    name, folder = f"tilewright_seeds_{uuid4().hex}", shared_folder(spark)

    def saved(df: DataFrame, part: str, keys: list[str]) -> DataFrame:
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{folder}/{name}/{part}").saveAsTable(f"{name}_{part}")
        return spark.table(f"{name}_{part}")

    texts = saved(chunks(records, record, seq, CHUNK, WORD, REACH), "chunks", ["record", "block"])
    places = texts.mapInArrow(lambda batches: _packed_places(batches, k), PLACES)
    counts = places.groupBy("seed").count()
    least = max((counts.agg(F.sum("count")).first()[0] or 0) / HOT, split_above)
    counts.where(F.col("count") > least).select("seed").write.parquet(f"{folder}/{name}/hot")
    hot = spark.read.parquet(f"{folder}/{name}/hot")
    salt = F.when(F.col("hot_"), F.pmod(F.xxhash64("record", "at"), F.lit(SALTS))).otherwise(0).cast("int")
    salted = places.join(F.broadcast(hot.withColumn("hot_", F.lit(True))), "seed", "left").withColumn("salt", salt).drop("hot_")
    whole = records.select(F.col(record).cast("string").alias("record"), F.col(seq).alias("seq"))
    return SeedIndex(saved(salted, "places", ["seed", "salt"]), hot, texts, whole, k, name)


def _distance(a: str, b: str, odd: str, mask: str) -> Column:
    """Bases that differ under a mask; a letter other than A, C, G, T differs from all."""
    return F.expr(f"bit_count((({a} ^ {b}) | shiftrightunsigned({a} ^ {b}, 1) | {odd}) & {0x5555555555555555} & {mask})")


def indexed_sites(queries: DataFrame, index: SeedIndex, query: str, mismatches: int, strand: str = "sense", once: bool = True) -> DataFrame:
    """As ``mismatch_sites``, from an index: (query, strand, record, start0, mismatches).

    A query of L bases is cut into L // k pieces. One of them has at most mismatches // pieces substitutions, so each
    piece's first k bases are looked up with so many; the index stays where it is. Up to 31 bases a site is compared by
    the bases beside its seed; longer ones that this leaves open are compared with the chunks' text. Queries shorter than
    a seed, longer than ``REACH``, with other letters, or whose seeds would need more than two substitutions are searched
    without the index, with the same result. Null queries have no site. Without ``once`` a site
    may stand twice where a record does, and queries of one piece need no shuffle of their sites.
    """
    k = index.k
    strands = {"sense": ["+"], "antisense": ["-"], "both": ["+", "-"]}[strand]
    size = F.length("word")
    n_pieces = F.floor(size / k)
    plain = (size >= k) & (size <= REACH) & (F.length(F.translate("word", "ACGT", "")) == 0) & (F.floor(F.lit(mismatches) / F.greatest(n_pieces, F.lit(1))) <= ODD)
    own = spread(queries.select(F.col(query).alias("query")), "query").where(F.col("query").isNotNull()).distinct().withColumn("word", F.col("query")).withColumn("plain", plain)
    shape = own.agg(F.max(F.when(F.col("plain"), size)), F.max((~F.col("plain")).cast("int"))).first()
    q = own.where("plain").select("query", F.explode(F.array(*[F.struct(F.lit(s).alias("strand"), (F.col("query") if s == "+" else reverse_complement("query")).alias("word")) for s in strands])).alias("x")).select("query", "x.*")

    xors, counts = substitutions(k, min(mismatches, ODD))
    q = q.withColumn("pieces", n_pieces.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    q = q.withColumn("off", F.floor(F.col("i") * size / F.col("pieces")).cast("int")).withColumn("nl", F.least("off", F.lit(WORD))).withColumn("nr", F.least(size - F.col("off"), F.lit(WORD)))
    q = q.withColumns({
        "ql": F.coalesce(packed_bases(F.substring("word", F.col("off") - F.col("nl") + 1, F.col("nl"))), F.lit(0)), "ml": F.expr("shiftleft(1L, 2 * nl) - 1"),
        "qr": packed_bases(F.substring("word", F.col("off") + 1, F.col("nr"))), "mr": F.expr(f"shiftleft(shiftleft(1L, 2 * nr) - 1, 2 * ({WORD} - nr))"),
    })
    within = F.element_at(F.array(*map(F.lit, counts)), F.floor(F.lit(mismatches) / F.col("pieces")).cast("int") + 1)
    xor = F.explode(F.slice(F.array(*[F.lit(x).cast("long") for x in xors]), F.lit(1), within))
    q = q.withColumn("seed", packed_bases(F.substring("word", F.col("off") + 1, F.lit(k)))).withColumn("qr", F.expr(f"shiftleft(qr, 2 * ({WORD} - nr))")).withColumn("xor", xor).withColumn("seed", F.col("seed").bitwiseXOR(F.col("xor")))
    salts = F.explode(F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    q = q.join(F.broadcast(index.hot.withColumn("hot_", F.lit(True))), "seed", "left").withColumn("salt", salts).select("query", "strand", "word", "off", "ql", "ml", "qr", "mr", "seed", "salt")

    found = q.hint("merge").join(index.places, ["seed", "salt"]).withColumn("start0", F.col("at") - F.col("off")).where((F.col("start0") >= 0) & (F.col("start0") + size <= F.col("n")))
    found = found.withColumn("m", _distance("ql", "before", "odd_before", "ml") + _distance("qr", "here", "odd_here", "mr")).where(F.col("m") <= mismatches)
    sure = (F.col("off") <= WORD) & (size - F.col("off") <= WORD)
    if not once and (shape[0] or 0) < min(2 * k, WORD + 1):  # one piece a query: its site is found by one seed, and compared whole
        one = found.select("query", "strand", "word", "record", "start0", F.col("m").alias("mismatches"), F.lit(True).alias("sure"))
    else:
        one = found.groupBy("query", "strand", "word", "record", "start0").agg(F.max("m").alias("mismatches"), F.max(sure).alias("sure"))  # seeds that see less of a site count no more than those that see all
    if (shape[0] or 0) > WORD:
        there = index.chunks.select("record", "block", "lead", "seq")
        # sites that are sure need no text; their blocks exist nowhere, and differ, so that they are not one hot key
        block = F.when(F.col("sure"), -1 - F.pmod(F.xxhash64("query", "start0"), F.lit(1 << 20))).otherwise(F.floor(F.col("start0") / CHUNK))
        text = F.substring(F.col("seq"), (F.col("lead") + F.pmod("start0", F.lit(CHUNK)) + 1).cast("int"), size)
        one = one.withColumn("block", block).join(there, ["record", "block"], "left")
        one = one.withColumn("mismatches", F.when(F.col("sure"), F.col("mismatches")).otherwise(hamming(F.col("word"), text))).where(F.col("mismatches") <= mismatches)
    out = one.select("query", "strand", "record", F.col("start0").cast("int").alias("start0"), F.col("mismatches").cast("int").alias("mismatches"))
    if not shape[1]:
        return out
    rest = mismatch_sites(own.where(~F.col("plain")), index.records, "query", "record", "seq", mismatches, strand)
    return out.unionByName(rest.select("query", "strand", "record", F.col("start0").cast("int").alias("start0"), F.col("mismatches").cast("int").alias("mismatches")))


def drop(index: SeedIndex) -> None:
    """Take the index's tables out of the catalog."""
    for part in ("places", "chunks"):
        index.places.sparkSession.sql(f"DROP TABLE IF EXISTS {index.name}_{part}")
