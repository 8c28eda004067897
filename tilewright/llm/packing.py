"""Best-fit packing: documents as token ids, cut where too long, packed by best-two-fit into sequences.

A document's ids are those of a public tokenizer (its path is a parameter), followed by an end id; a
null text has the end id alone. Documents longer than a sequence are cut into pieces of its size, the last one
shorter. Pieces are dealt by a hash of their row's place into groups of about ``GROUP`` rows, and each group is
packed in a task of its own by lengths: a sequence is filled greedily with the longest piece that fits; then its
smallest piece is exchanged for the two unpacked ones that fill the widened gap best, if they fill it better.

Ties between equal lengths go to the smaller id and piece. Repeated rows are packed each; an empty table gives an
empty one. Each group may leave one sequence half empty, which is one in thousands.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, lean

CAPACITY = 4096
END_ID = 1
GROUP = 20_000
#: Words, and parts of words, that a worker keeps with their ids; beyond, it begins anew.
MOST_WORDS = 400_000
#: A word, and the ASCII signs at its end.
HEAD_AND_SIGNS = re.compile(r"([^\n]*?)([!-/:-@\[-`{-~]*)\n")
#: Beyond these characters Python and the tokenizer may lower-case differently.
BEYOND_LATIN = "[^\x00-\u012F\u0131-\u024F]"
#: Stands between words that are encoded together; words that hold it are encoded alone.
BETWEEN = "\x01"

_loaded: dict[str, WordIds] = {}


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """A tokenizer that drops white space and case, with the ids of the words it has met.

    Texts are split at blanks and line ends only; no merge crosses these, so a text's ids are its words' in turn. Nor
    does one cross from a letter or digit to signs, so a word with ASCII signs behind is the ids of both parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # texts that are not lower-cased beforehand, and heads of words that hold an added token
        self.as_is = re.compile("|".join([BEYOND_LATIN, *(f"(?i:{re.escape(t)})" for t in added)]))
        self.special = re.compile("|".join(re.escape(HEAD_AND_SIGNS.match(t + "\n")[1] or t) for t in added) or r"(?!)")
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _encoded(self, words: list[str], sep: str) -> None:
        """Adds ``words`` to ``parts``, many in one call; where the cuts between them are in doubt, each by itself."""
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([sep.join(some)], add_special_tokens=False)[0].ids, "<u4")
            if sep == " ":  # runs of letters, or of signs, end in one id of a word's end each
                last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                first = [0, *last[:-1]]
            else:
                at = np.flatnonzero(ids == self.between[0]).tolist() if len(self.between) == 1 else []
                first, last = [0, *(x + 1 for x in at)], [*at, len(ids)]
            if len(first) == len(some):
                data = ids.tobytes()
                self.parts.update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, first, last, strict=True))
            else:
                each = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                self.parts.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, each, strict=True))

    def _learn(self, words: list[str]) -> None:
        split = HEAD_AND_SIGNS.findall("\n".join(words) + "\n")
        heads, signs = map(list, zip(*split, strict=True)) if split else ([], [])
        new = set(heads).difference(self.parts)
        # no letter or digit before the signs, once lower-cased: they may be one with what stands there
        odd = {h for h in new if not h.lower()[-1].isalnum() or self.special.search(h)}
        if odd:
            for i, h in enumerate(heads):
                if h in odd:
                    heads[i], signs[i] = words[i], ""
            new = set(heads).difference(self.parts)
        new |= set(signs).difference(self.parts)
        plain = {w for w in new if w.lower().isalpha() or w.isascii() and HEAD_AND_SIGNS.match(w + "\n")[1] == ""}
        self._encoded(list(plain), " ")
        self._encoded([w for w in new - plain if BETWEEN not in w], f" {BETWEEN} ")
        for w in new:
            if BETWEEN in w:
                self.parts[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        part = self.parts.__getitem__
        self.known.update(zip(words, map(add, map(part, heads), map(part, signs)), strict=True))
        for w in new:
            if len(w) > 64:
                del self.parts[w]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [(t if self.as_is.search(t) else t.lower()).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > MOST_WORDS:
            self.known = {"": b""}
        if len(self.parts) > MOST_WORDS:
            self.parts = {"": b""}
        known = self.known
        got = [list(map(known.get, s)) for s in split]
        missing = [[i for i, x in enumerate(g) if x is None] for g in got]
        new = {s[i] for s, m in zip(split, missing, strict=True) for i in m}
        if new:
            self._learn(list(new))
        for s, g, m in zip(split, got, missing, strict=True):
            for i in m:
                g[i] = known[s[i]]
        out = list(map(b"".join, got))
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: none are made here, and each would walk through all the words that are known."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _tokenizer(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids]) of each document."""
    path = path or public_path()
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows, at = [], []
                with _uncollected():
                    encoded = tok.ids([t or "" for t in part.column(1).to_pylist()])
                for i, ids in enumerate(encoded):
                    ids += end
                    for n, b in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[b : b + 4 * capacity]
                        rows.append((n, b // 4, len(own) // 4, zlib.crc32(own), own))
                        at.append(i)
                cols = list(zip(*rows, strict=True))
                arrays = [part.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False))]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(lean(run), schema)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, in the order given among equal lengths; lengths are 1 to capacity."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    given = np.zeros(capacity + 1, np.int64)  # how many of a length have been handed out
    # the largest length at hand up to each
    below = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> None:
        count[n] -= 1
        if not count[n]:
            below[n : np.searchsorted(below, n, "right")] = below[n - 1]

    def give_back(n: int) -> None:
        if not count[n]:
            below[n : np.searchsorted(below, below[n - 1], "right")] = n
        count[n] += 1

    number = 0
    while below[capacity]:
        inside, gap = [], capacity
        while n := int(below[gap]):
            take(n)
            inside.append(n)
            gap -= n
        if gap and below[capacity]:
            least = inside[-1]
            wide = gap + least
            a = np.flatnonzero(count[: wide + 1])
            a = a[a > 0]
            b = below[wide - a]
            alone = (b == a) & (count[a] == 1)
            b = np.where(alone, below[np.maximum(a - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > least:
                best = int(total.argmax())
                x, y = int(a[best]), int(b[best])
                take(x)
                take(y)
                give_back(least)
                inside[-1:] = [x, y]
        at = 0
        for n in inside:
            i = order[first[n] + given[n]]
            given[n] += 1
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """``rows`` (of ``pieces``) with sequence_id and offset."""
    rows = cut(rows)
    n = max(1, -(-rows.count() // group))
    # by a row's place in the kept table, so that rows of one id, or the same row many times, are dealt evenly too
    dealt = rows.withColumn("group_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    schema = rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(k: tuple, t: pa.Table) -> pa.Table:
        t = t.drop_columns(["group_"]).sort_by([("length", "ascending"), (key, "ascending"), ("piece", "ascending")])
        seq, off = best_two_fit(t.column("length").to_numpy(), capacity)
        return t.append_column("sequence_id", pa.array(seq + (int(k[0].as_py()) << 32))).append_column("offset", pa.array(off))

    return dealt.groupBy("group_").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed rows that have ids; the training input."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids")).withColumn("length", F.size("ids"))
