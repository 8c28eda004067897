"""N-gram Jaccard join with PartEnum signatures.

Words are runs without white space, A-Z lower-cased. A document's set: its distinct 5-word shingles (as 64-bit
hashes); with fewer words, the whole sequence as one; without words or text, empty and linked with nothing. Two
documents link when intersection / union >= 3 / 4, that is, when their sets differ in at most (x + y) / 7 elements.

Signatures. Sizes fall into bands whose ends are in the proportion 3 : 4; linked sets are of one band or of
neighbours, so each set takes part for its own band and for the one below. For a band the domain of shingles is
split into parts and each part into three; with k differences in all, at most k / 2 parts have two or more, and in
any other part two of the three sub-parts are alike. So each part enumerates its three pairs of sub-parts as
signatures (empty ones are left out), and a set stops after floor(k / 2) + 1 parts with two filled sub-parts: one of
them must match. A set with fewer such parts also emits the first x - ceil(3x / 4) + 1 of its sorted shingles, which
covers the pairs of two such sets.

Work. Equal sets are one class, so copies cost nothing. Signatures are sent in packed form, by ranges of their hash.
Classes that share a signature are candidates: all pairs where few share one, else pairs with three pivots. Sketches
of parities rule out what differs too much, and exact intersections of the sets, read again from the texts and shuffled
once, decide. Then connected components are found. Of a run (the classes that share a signature) only members outside
its largest component, the strays, are compared further, each with the members of other components. A pair meets in as
many runs as it shares signatures; it is proposed in the first one only, as far as the lists of each class's first runs
tell, so a large group of near copies costs about one comparison a member. Small runs are finished at once, large ones
by some partners a stray first and then by all, so no link between components is lost.

Results: each row's doc_id, n_shingles and component_id, the smallest doc_id that links reach (of rows without id:
null). Repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, free_name, lean, shuffle_partitions
from .vectors import SPACED, chunks, lower_ascii, mix, row_bounds, span_hashes, words

WIDTH = 5
#: Classes that share a signature are compared all with all up to this many.
FEW = 4
PIVOTS = 3
#: Partners a stray gets in the first later round from a run of more than SMALL_RUN; afterwards all that are left.
PARTNERS = 16
SMALL_RUN = 64
#: The first runs of a class that travel with it, by which a pair finds the first run it shares.
FIRST_RUNS = 8
#: Members of a run that one task compares with its strays; a larger run's members are dealt over blocks.
RUN_BLOCK = 4096
PAIRS_AT_ONCE = 200_000
SIGNATURES_PER_TASK = 3_000_000
#: Bits of a signature that are compared, beyond those that number all of them: chance meetings cost a comparison each, no
#: result, and stay a share of the signatures. No more than SIG_BYTES hold.
SPARE_BITS, SIG_BYTES = 13, 6
BROADCAST_ROWS = 500_000  # of about 40 bytes each


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b, data, offsets in chunks(column):
        data = lower_ascii(data)
        starts, ends, rows = words(data, offsets, SPACED)
        h = span_hashes(data, starts, ends)
        at = row_bounds(rows, b - a)
        s = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64)
        for j in range(WIDTH):
            s = s * np.uint64(0x100000001B3) + h[j : j + len(s)]
        s = mix(s)
        for i in range(b - a):
            n = at[i + 1] - at[i]
            if n >= WIDTH:
                out.append(np.unique(s[at[i] : at[i + 1] - WIDTH + 1]))
            elif n:
                one = np.array([n], np.uint64)
                for v in h[at[i] : at[i + 1]]:
                    one = mix(one * np.uint64(0x9E3779B97F4A7C15) + v)
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out



def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set, as Spark's long."""
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's elements over a power of two of bits, at least two an element.

    Each element that two sets do not share changes one parity at most, so the bits that differ are no more than the
    elements that differ: a lower bound that rules out most candidates at a thirtieth of their sets' bytes.
    """
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount(((s >> np.uint64(9)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def _alike(sketches: list[bytes], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the sketches ``i`` and ``j`` differ in at most ``most`` bits; one of more bits is folded to the other's.

    Index bits are dropped from above, so folding adds blocks up.
    """
    length = np.array([len(x) for x in sketches], np.int64)
    place = np.zeros(len(sketches), np.int64)
    of: dict[int, np.ndarray] = {}
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        place[own] = np.arange(len(own))
        of[int(n)] = np.frombuffer(b"".join([sketches[x] for x in own]), np.uint64).reshape(len(own), -1)
    out = np.zeros(len(i), bool)
    both = length[i] << 32 | length[j]
    for pair in np.unique(both):
        la, lb = int(pair) >> 32, int(pair) & 0xFFFFFFFF
        size = min(la, lb) // 8
        at = np.flatnonzero(both == pair)
        for k in range(0, len(at), max(1, 4_000_000 // max(la, lb))):
            some = at[k : k + max(1, 4_000_000 // max(la, lb))]
            x, y = (np.bitwise_xor.reduce(of[n][place[z[some]]].reshape(len(some), -1, size), axis=1) for n, z in ((la, i), (lb, j)))
            out[some] = np.bitwise_count(x ^ y).sum(1) <= most[some]
    return out


def _band_tops(most: int = 1 << 40) -> np.ndarray:
    """The last size of each band: 1, 2, 4, 6, ...; from l to floor(4 l / 3)."""
    out, low = [], 1
    while low < most:
        out.append(low * 4 // 3)
        low = out[-1] + 1
    return np.array(out)


TOPS = _band_tops()


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) of all sets; see the module."""
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    f = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    rank = np.arange(len(f)) - np.repeat(np.cumsum(size) - size, size)
    band = np.searchsorted(TOPS, np.maximum(size, 1))
    sigs, owners = [], []
    for below in (0, 1):
        inst = band - below
        joins = (size > 0) & (inst >= 0)
        top = TOPS[np.maximum(inst, 0)]
        differ = (size + np.where(below, np.minimum(top, size), size * 4 // 3)) // 7
        enough = differ // 2 + 1
        parts = np.where(joins, top // 5 + 4, 0)
        here = joins[owner]
        g, own = f[here], owner[here]
        base = np.cumsum(parts) - parts
        part = ((g >> np.uint64(32)) * parts[own].astype(np.uint64)) >> np.uint64(32)
        slot = (base[own] + part.astype(np.int64)) * 3 + ((g & np.uint64(0xFFFFFF)) % np.uint64(3)).astype(np.int64)
        content = np.zeros(3 * int(parts.sum()), np.uint64)
        np.add.at(content, slot, mix(g + np.uint64(1)))
        filled = (np.bincount(slot, minlength=len(content)) > 0).reshape(-1, 3)
        content = content.reshape(-1, 3)
        of = np.repeat(np.arange(len(sets)), parts)
        good = filled.sum(1) >= 2
        so_far = np.cumsum(good) - good
        before = so_far - so_far[np.minimum(base, max(0, len(good) - 1))][of] if len(good) else so_far
        use = before < enough[of]
        number = np.arange(len(of)) - base[of]
        tag = mix((inst[of].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
        for left_out in range(3):
            a, b = (i for i in range(3) if i != left_out)
            there = use & (filled[:, a] | filled[:, b])
            h = mix(content[there, a] * np.uint64(0xD6E8FEB86659FD93) + mix(content[there, b] + np.uint64(left_out)) + tag[there])
            sigs.append(h)
            owners.append(of[there])
        thin = joins & (np.bincount(of[good], minlength=len(sets)) < enough)
        prefix = size - (3 * size + 3) // 4 + 1
        single = here & thin[owner] & (rank < prefix[owner])
        sigs.append(mix(f[single] ^ mix(inst[owner[single]].astype(np.uint64) + np.uint64(1 << 50))))
        owners.append(owner[single])
    return np.concatenate(sigs), np.concatenate(owners)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte, the lowest of all first: bytes that are mostly zero stand together, which the shuffle compresses."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def _packed(sets: list[np.ndarray], keys: list[int], n: int, bits: int) -> pa.RecordBatch:
    """Signatures by range of their hash: a row a range, with the first bits of each signature in ascending order as
    distances, about three bytes each, and its class's place among the names of the classes that have any there."""
    sig, own = signatures(sets)
    sig >>= np.uint64(64 - bits)
    order = np.argsort(sig)
    sig, own = sig[order], own[order]
    part = ((sig >> np.uint64(bits - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)
    numbers, begin = np.unique(part, return_index=True)
    end = np.append(begin[1:], len(part))
    keys_ = np.array(keys, "<i8")
    cols: list[list[bytes]] = [[], [], []]
    for a, b in zip(begin, end, strict=True):
        there, place = np.unique(own[a:b], return_inverse=True)
        for c, x in zip(cols, (_planes(np.diff(sig[a:b], prepend=np.uint64(0)), SIG_BYTES), _planes(place, 2), keys_[there].tobytes()), strict=True):
            c.append(x)
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], ["part", "sigs", "own", "names"])


def _candidates(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Pairs (kind 0: a < b) and, of signatures with many classes, members (kind 1: run, class), each once."""
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    same = sig[1:] == sig[:-1]
    shared = np.zeros(len(sig), bool)
    shared[1:] |= same
    shared[:-1] |= same
    sig, key = sig[shared], key[shared]
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(sig)))
    start, m = np.repeat(first, count), np.repeat(count, count)
    at = np.arange(len(sig))
    a, b = [], []
    for d in range(1, FEW):
        i = at[(m <= FEW) & (at - start >= d)]
        a.append(key[i - d])
        b.append(key[i])
    for d in range(PIVOTS):
        i = at[(m > FEW) & (at - start > d)]
        a.append(key[start[i] + d])
        b.append(key[i])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
    many = count > FEW
    runs, members = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if many.any():
        name = np.add.reduceat(mix(key.astype(np.uint64)), first)
        name, one = np.unique(np.where(many, name, np.uint64(0)), return_index=True)
        one = one[many[one]]
        inside = np.isin(start, first[one])
        members = key[inside]
        runs = np.repeat(np.add.reduceat(mix(key.astype(np.uint64)), first)[np.isin(np.arange(len(first)), one)], count[np.isin(np.arange(len(first)), one)]).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(runs), np.int32)])), pa.array(np.concatenate([pairs[:, 0], runs])), pa.array(np.concatenate([pairs[:, 1], members]))],
        ["kind", "a", "b"],
    )


def document_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, n_shingles, set_key, sketch) of each row; hash is of the text, the last two are null for the empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], [key, "hash", "n_shingles", "set_key", "sketch"])

    return docs.select(key, F.xxhash64(text).alias("hash"), text).mapInArrow(lean(run), f"`{key}` {kind}, hash long, n_shingles long, set_key long, sketch binary")


def candidates(docs: DataFrame, tasks: int, text: str = "text", bits: int = 8 * SIG_BYTES) -> DataFrame:
    """(kind, a, b) of classes that share the first bits of a signature, as ``_candidates`` gives them for each range."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                for s in shingle_sets(batch.column(0).slice(a, 200)):
                    if len(s) and (k := set_key(s)) not in sets:
                        sets[k] = s
                        size += len(s) + 20
                if size > 300_000 or len(sets) > 50_000:
                    yield _packed(list(sets.values()), list(sets), tasks, bits)
                    sets, size = {}, 0
        if sets:
            yield _packed(list(sets.values()), list(sets), tasks, bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            for part, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_part.setdefault(part, []).append(tuple(blobs))
        for part in sorted(by_part):
            blobs = by_part.pop(part)
            sig = np.concatenate([np.cumsum(_from_planes(x[0], SIG_BYTES), dtype=np.uint64) for x in blobs])
            key = np.concatenate([np.frombuffer(x[2], "<i8")[_from_planes(x[1], 2).astype(np.int64)] for x in blobs])
            del blobs
            out = _candidates(sig, key)
            del sig, key
            for a in range(0, out.num_rows, 50_000):
                yield out.slice(a, 50_000)

    packed = docs.select(text).mapInArrow(lean(emit), "part int, sigs binary, own binary, names binary")
    return packed.repartitionById(tasks, "part").mapInArrow(lean(meet), "kind int, a long, b long")


def _verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link. Pairs of one a are dealt over blocks of about 64, each with a's set once.

    The texts' readers are told which blocks want a class's set (by broadcast while these are few), so sets are shuffled
    once and only those of candidates.
    """
    spark = pairs.sparkSession
    count = pairs.groupBy("a").count()
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / 64)).cast("int").alias("block")
    members = cut(pairs.join(count, "a").select("a", block, "b"))
    to = members.select(F.col("b").alias("set_key"), F.struct("a", "block", F.lit(1).alias("role")).alias("to"))
    to = to.unionAll(members.select("a", "block").distinct().select(F.col("a").alias("set_key"), F.struct("a", "block", F.lit(0).alias("role")).alias("to")))
    wanted = cut(to.groupBy("set_key").agg(F.collect_list("to").alias("to")).join(info.select("set_key", "rep"), "set_key"))
    few = 2 * members.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(key).alias("id_"), text)
    rows = rows.join(F.broadcast(wanted) if few else wanted, F.col("id_").eqNullSafe(F.col("rep"))).select(text, "set_key", "to.a", "to.block", "to.role")
    names = ["set_key", "a", "block", "role", "items"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                part = batch.slice(x, 500)
                out: list[tuple] = []
                size = 0
                for s, k, *to in zip(shingle_sets(part.column(0)), *(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    if not len(s) or set_key(s) != k:
                        continue  # another text of the same id
                    items = s.tobytes()
                    for t in zip(*to, strict=True):
                        out.append((k, *t, items))
                        size += len(items)
                        if size > 8_000_000:
                            yield _batch(out)
                            out, size = [], 0
                if out:
                    yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, a, block, role, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(items, np.uint64)
                if role == 0:
                    now, own = (a, block), s
                elif now == (a, block):
                    both = np.intersect1d(own, s, assume_unique=True).size if 4 * min(len(own), len(s)) >= 3 * max(len(own), len(s)) else 0
                    if 100 * both >= 75 * (len(own) + len(s) - both):
                        found.append((a, k))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    sets = rows.mapInArrow(lean(send), "set_key long, a long, block int, role int, items binary")
    met = sets.repartition(shuffle_partitions(spark), "a", "block").sortWithinPartitions("a", "block", "role")
    return met.mapInArrow(lean(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, by rounds of large-star and small-star.

    Each round halves paths, so rounds grow with the logarithm of the longest; every round is kept in the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        if new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = new


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) after further ``links``: only the components that these touch are worked on."""
    of = known.select(F.col("node").alias("n_"), F.col("component").alias("c_"))
    ends = links
    for x in "ab":
        ends = ends.join(of, F.col(x) == F.col("n_"), "left").withColumn(x, F.coalesce("c_", x)).drop("n_", "c_")
    more = components(ends).select(F.col("node").alias("n_"), F.col("component").alias("c_"))
    old = known.join(more, F.col("component") == F.col("n_"), "left").select("node", F.coalesce("c_", "component").alias("component"))
    return cut(old.unionAll(more.select("n_", "c_")))  # components' own names were no nodes of known


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sizes and sketches allow a link."""
    one, two = (info.select(F.col("set_key").alias(x), F.col("n_shingles").alias("n" + x), F.col("sketch").alias("s" + x)) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b", ((F.col("na") + F.col("nb")) / 7).cast("long").alias("most"), "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.arange(batch.num_rows)
            ok = _alike(batch.column(3).to_pylist() + batch.column(4).to_pylist(), n, n + len(n), batch.column(2).to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _stray_pairs(t: pa.Table, most: int | None) -> pa.RecordBatch:
    """Plausible pairs (a, b) of strays and members of other components in whole runs or blocks of runs; see ``_crossing``."""
    run, block, key, c, main, n, own = (t.column(i).to_numpy() for i in ("a", "block", "b", "c", "main", "n_shingles", "own"))
    sketches = t.column("sketch").to_pylist()
    lists = t.column("first").combine_chunks()
    long = np.diff(lists.offsets.to_numpy())
    first = np.full((len(run), FIRST_RUNS), np.iinfo(np.int64).max)
    first[np.repeat(np.arange(len(run)), long), np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)] = lists.flatten().to_numpy()
    limit = t.column("most").to_numpy()
    begins = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (block[1:] != block[:-1])))
    found: list[np.ndarray] = []
    here: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        i, j = (np.concatenate(x) for x in zip(*here, strict=True))
        ok = (c[i] != c[j]) & ((c[j] == main[j]) | (key[j] > key[i])) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        # an earlier run of both has the pair as well
        seen = ((first[i][:, :, None] == first[j][:, None, :]) & (first[i] < run[i][:, None])[:, :, None]).any((1, 2))
        i, j = i[~seen], j[~seen]
        ok = _alike(sketches, i, j, (n[i] + n[j]) // 7)
        i, j = i[ok], j[ok]
        if most is not None and len(i):
            order = np.lexsort((mix(key[j].astype(np.uint64) ^ key[i].astype(np.uint64)), i))
            i, j = i[order], j[order]
            new = np.append(True, i[1:] != i[:-1])
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            ok = ~limit[i] | (rank < most)
            i, j = i[ok], j[ok]
        found.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], 1))

    for x, y in zip(begins, np.append(begins[1:], len(run)), strict=True):
        at = np.arange(x, y)
        strays, members = at[c[x:y] != main[x:y]], at[own[x:y]]
        step = max(1, PAIRS_AT_ONCE // max(1, len(members)))
        for k in range(0, len(strays), step):
            some = strays[k : k + step]
            here.append((np.repeat(some, len(members)), np.tile(members, len(some))))
            size += len(some) * len(members)
            if size >= PAIRS_AT_ONCE:
                flush()
                here, size = [], 0
    if here:
        flush()
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _crossing(runs: DataFrame, known: DataFrame, info: DataFrame, most: int | None) -> DataFrame:
    """Plausible pairs (a, b) of a run's strays (members outside its largest component) with members of other components.

    ``runs`` has (a, b): run, class. Rows are numbers and sketches, not sets, and each class's first runs. A run of
    more than ``RUN_BLOCK`` members is dealt over blocks, each with all of its strays. With ``most``, a stray takes so
    many partners at once from a run of more than ``SMALL_RUN``; without it, only such runs are looked at.
    """
    sizes = known.groupBy("component").agg(F.count("*").alias("weight"))
    known = known.join(sizes, "component")
    rows = runs.join(known, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("component", "b").alias("c"), F.coalesce("weight", F.lit(0)).alias("w"))
    size = rows.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.struct("w", "c")).alias("m"), F.count("*").alias("n")).where("low < high")
    if most is None:
        size = size.where(F.col("n") > SMALL_RUN)
    size = size.select("a", F.col("m.c").alias("main"), F.ceil(F.col("n") / RUN_BLOCK).cast("int").alias("blocks"), (F.col("n") > SMALL_RUN).alias("most"))
    rows = rows.join(size, "a").join(info.select("set_key", "n_shingles", "sketch", "first"), F.col("b") == F.col("set_key"))
    home = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    rows = rows.withColumn("home", home).withColumn("block", F.explode(F.when(F.col("c") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("a", "block", "b", "c", "main", "n_shingles", (F.col("block") == F.col("home")).alias("own"), "sketch", "first", "most")
    rows = rows.repartition(shuffle_partitions(runs.sparkSession), "a", "block").sortWithinPartitions("a", "block")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            run, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.flatnonzero((run != run[-1]) | (block != block[-1]))[-1]) + 1 if len(run) and ((run != run[-1]) | (block != block[-1])).any() else 0
            begun = rest and len(run) and (rest[-1].column(0)[-1].as_py(), rest[-1].column(1)[-1].as_py()) == (run[-1], block[-1])
            if last or (rest and not begun):
                done = pa.Table.from_batches([*rest, batch.slice(0, last)])
                rest = []
                yield _stray_pairs(done, most)
            if last < batch.num_rows:
                rest.append(batch.slice(last))
        if rest:
            yield _stray_pairs(pa.Table.from_batches(rest), most)

    return rows.mapInArrow(lean(pairs), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, hash (of its text), n_shingles, component_id, and whether it is of the set that stands for its component."""
    spark = docs.sparkSession
    rows = cut(document_sets(docs, key, text))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(shuffle_partitions(spark), -(-total // SIGNATURES_PER_TASK))
    bits = min(max(total.bit_length() + SPARE_BITS, 32), 8 * SIG_BYTES)
    found = cut(candidates(docs, tasks, text, bits))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    runs = cut(found.where("kind = 1").select("a", "b").distinct())
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    met = pairs.select("a").unionAll(pairs.select("b")).unionAll(runs.select("b")).distinct().withColumnRenamed("a", "set_key")
    first = runs.groupBy(F.col("b").alias("set_key")).agg(F.slice(F.array_sort(F.collect_list("a")), 1, FIRST_RUNS).alias("first"))
    info = cut(classes.join(met, "set_key", "left_semi").join(first, "set_key", "left"))
    tried = cut(_plausible(pairs, info))
    known = components(_verified(tried, info, docs, key, text))
    for most in (PARTNERS, None):
        more = cut(_crossing(runs, known, info, most).join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            tried = tried.unionAll(more)
            known = _joined(known, _verified(more, info, docs, key, text))
    return _labelled(rows, classes, known, key)


def _labelled(rows: DataFrame, classes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    named = classes.select("set_key", "rep").join(known, F.col("set_key") == F.col("node"), "left").select("set_key", "rep", F.coalesce("component", "set_key").alias("c"))
    least = named.groupBy("c").agg(F.min(F.struct("rep", "set_key")).alias("m"), F.min("rep").alias("least"))
    linked = named.join(least, "c").select("set_key", "least", F.col("m.set_key").alias("first_set"))
    alone = F.col("set_key").isNull()
    first = alone | ((F.col("set_key") == F.col("first_set")) & F.col(key).eqNullSafe(F.col("least")))
    return rows.join(linked, "set_key", "left").select(key, "hash", "n_shingles", F.when(alone, F.col(key)).otherwise(F.col("least")).alias("component_id"), first.alias("stands"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Rows without words all stay.

    The ids of the others are broadcast while they are few, else joined by a shuffle. Only where ids repeat are rows
    of one id and text compared.
    """
    rows = cut(jaccard_components(docs, key, text))
    (hash_,) = free_name(docs, "hash_")
    kept = docs.withColumn(hash_, F.xxhash64(text))
    kept = without(kept, rows.where(~F.col("stands")).select(key, "hash").distinct(), key, hash_)
    again = rows.where("stands and n_shingles > 0").groupBy(key, "hash").count().where("count > 1").select(key, "hash")
    if not again.isEmpty():
        same = kept[key].eqNullSafe(again[key]) & (kept[hash_] == again["hash"])
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([key, hash_]))
    return kept.drop(hash_)


def without(docs: DataFrame, dropped: DataFrame, key: str, hash_: str) -> DataFrame:
    """``docs`` without the rows whose key and text hash are in ``dropped`` (key, hash)."""
    dropped = cut(dropped.select(F.col(key).alias("key_of_dropped"), F.col("hash").alias("hash_of_dropped")))
    few = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return docs.join(few, docs[key].eqNullSafe(few["key_of_dropped"]) & (docs[hash_] == few["hash_of_dropped"]), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
