"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Base kinds, each leftmost and non-overlapping: email, ip (parts at most 255), card (16 to 19 digits that pass
Luhn) and phone (8 to 15 digits); a match that fails its check is dropped. The field labels the tokens (runs
without white space) near a digit or an ``@``: a linear chain over neighbours, and skip edges between distant
tokens of a document that are equal or share a long run of digits or an address. Their shared potentials and
loopy message passing, run until it settles, let one sure mention decide the others however many lie between. What
it labels with enough certainty, and no base span overlaps, is added; base spans always stay.

Offsets count code points, ends are exclusive. Null is the empty text and has no spans. Rows are independent:
repeated rows stay, an empty table gives an empty one. Tokens without digit or ``@`` and more than two tokens
away from one are outside by definition of the model, so long prose costs one search.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import lean
from .vectors import byte_class, chunks

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # a run of digits that fails from its start fails from within
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in found.split("."))
    if kind in ("card", "phone"):
        digits = re.sub("[^0-9]", "", found)
        return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15
    return True


def _could_be(kind: str, found: str) -> bool:
    """What any spelling of a kind must have; it keeps the field from adding what its kind rules out, such as cards that fail Luhn."""
    if kind == "email":
        return "@" in found
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    digits = re.sub("[^0-9]", "", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _starts(kind: str, text: str) -> Iterator[re.Match]:
    """As ``finditer``; the email pattern only near an ``@``, else long runs of its letters cost their square."""
    if kind != "email":
        yield from PATTERNS[kind].finditer(text)
        return
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := PATTERNS[kind].match(text, a)):
            yield m
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    return [(k, m.start(), m.end()) for k in KINDS for m in _starts(k, text) if _passes(k, m[0])]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the field

LABELS = ("O", *KINDS)
BUCKETS = 1 << 14
ROUNDS_A_NODE = 10
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_SHAPE = [(re.compile(r"[0-9]"), "d"), (re.compile(r"[a-z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\x00-\x7F]+"), "u")]


def _near_tokens(text: str, reach: int = 2) -> list[list[tuple[int, int]]]:
    """Segments: runs of tokens within ``reach`` tokens of one with a digit or an ``@``."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _ in spans])
    marks = np.array([m.start() for m in _TRIGGER.finditer(text)])
    hot = np.unique(np.searchsorted(starts, marks, "right") - 1)
    segments: list[list[tuple[int, int]]] = []
    end = 0
    for i in hot.tolist():
        a, b = max(i - reach, 0), min(i + reach + 1, len(spans))
        if segments and a <= end:
            segments[-1] += spans[end:b]
        else:
            segments.append(spans[a:b])
        end = b
    return segments


def _features(tokens: list[str], i: int) -> list[int]:
    t = tokens[i]
    shape = t
    for r, c in _SHAPE:
        shape = r.sub(c, shape)
    digits = re.sub("[^0-9]", "", t)
    joined = re.sub("[^0-9]", "", "".join(tokens[max(0, i - 3) : i + 4]))
    out = [
        "b", f"s={shape[:24]}", f"n={min(len(digits), 20)}", f"at={'@' in t}", f"dots={min(t.count('.'), 4)}", f"plus={t[:1] == '+'}", f"len={min(len(t), 30) // 3}",
        f"luhn={16 <= len(digits) <= 19 and luhn(digits)}", f"ip={bool(m := PATTERNS['ip'].search(t)) and _passes('ip', m[0])}", f"mail={bool(PATTERNS['email'].search(t)) if '@' in t else False}",
        f"near={8 <= len(joined) <= 15}", f"any={bool(digits)}",
    ]
    for d in (-2, -1, 1, 2):
        near = tokens[i + d] if 0 <= i + d < len(tokens) else "^"
        out += [f"{d}w={'#' if near[:1].isdigit() else 'w'}{near[:1] == '+'}{near[:1] == '('}{'@' in near}"]
        s = near
        for r, c in _SHAPE:
            s = r.sub(c, s)
        if any(x in s for x in "d@"):
            out.append(f"{d}s={s[:16]}")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in out]


def _link_keys(token: str) -> list[str]:
    """Two tokens with a key in common are joined by a skip edge."""
    bare = token.strip(".,;:!?()[]{}\"'<>").lower()
    keys = []
    digits = re.sub("[^0-9]", "", bare)
    if len(digits) >= 7:
        keys.append("d" + digits[-7:])
    if "@" in bare:
        keys.append("m" + bare)
    if bare and (len(digits) >= 3 or "@" in bare) and len(bare) >= 6:
        keys.append("t" + bare)
    return keys


@dataclass
class Field:
    """Weights of token features, chain transitions and agreement along skip edges, in log space."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    sure: float = 0.9
    settled: float = 1e-4
    damping: float = 0.5

    def marginals(self, segments: list[list[str]]) -> list[np.ndarray]:
        """Loopy sum-product over a document's segments, joined by skip edges, until no message changes."""
        tokens = [t for s in segments for t in s]
        if not tokens:
            return []
        local = np.array([self.unary[_features(s, i)].sum(0) for s in segments for i in range(len(s))])
        edges, kinds, n = [], [], 0
        seen: dict[str, int] = {}
        for s in segments:
            for i, t in enumerate(s):
                if i:
                    edges.append((n - 1, n))
                    kinds.append(0)
                for k in set(_link_keys(t)):
                    # each mention is tied to the one before it, so that a document's edges stay few
                    if k in seen and seen[k] < n - 1:
                        edges.append((seen[k], n))
                        kinds.append(1)
                    seen[k] = n
                n += 1
        if edges:
            self._pass_messages(local, np.array(edges), np.array(kinds))
        p = np.exp(local - np.logaddexp.reduce(local, axis=1)[:, None])
        return list(np.split(p, np.cumsum([len(s) for s in segments])[:-1]))

    def _pass_messages(self, belief: np.ndarray, e: np.ndarray, kinds: np.ndarray) -> None:
        """Add to each node what its edges say, until no message changes; only edges at nodes that changed are done again.

        Damped, as loops can make messages swing; those that never settle end after ROUNDS_A_NODE rounds a node, when
        evidence has long crossed the graph.
        """
        both = np.stack([self.chain, self.skip])
        forth, back = np.zeros((len(e), len(LABELS))), np.zeros((len(e), len(LABELS)))
        live = np.arange(len(e))
        for _ in range(ROUNDS_A_NODE * (len(belief) + 20)):
            u, v, pots = e[live, 0], e[live, 1], both[kinds[live]]
            f = np.logaddexp.reduce((belief[u] - back[live])[:, :, None] + pots, axis=1)
            b = np.logaddexp.reduce((belief[v] - forth[live])[:, None, :] + pots, axis=2)
            f = (f - np.logaddexp.reduce(f, axis=1)[:, None] - forth[live]) * (1 - self.damping)
            b = (b - np.logaddexp.reduce(b, axis=1)[:, None] - back[live]) * (1 - self.damping)
            forth[live] += f
            back[live] += b
            np.add.at(belief, v, f)
            np.add.at(belief, u, b)
            changed = np.zeros(len(belief), bool)
            changed[v[np.abs(f).max(1) > self.settled]] = True
            changed[u[np.abs(b).max(1) > self.settled]] = True
            live = np.flatnonzero(changed[e[:, 0]] | changed[e[:, 1]])
            if not len(live):
                break

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field adds: runs of tokens of one kind, all sure, bare of outer punctuation."""
        segments = _near_tokens(text)
        taken = disjoint(base)
        out: list[Span] = []
        for spans, p in zip(segments, self.marginals([[text[a:b] for a, b in s] for s in segments]), strict=True):
            best, top = p.argmax(1), p.max(1)
            i = 0
            while i < len(spans):
                j = i + 1
                if best[i] and top[i] >= self.sure:
                    while j < len(spans) and best[j] == best[i] and top[j] >= self.sure and best[i] == 1 + KINDS.index("phone"):
                        j += 1
                    a, b = spans[i][0], spans[j - 1][1]
                    while a < b and text[a] in ".,;:!?[]{}\"'<>)":
                        a += 1
                    while a < b and text[b - 1] in ".,;:!?[]{}\"'<>(":
                        b -= 1
                    at = bisect_left(taken, (b,))
                    if a < b and _could_be(KINDS[best[i] - 1], text[a:b]) and (not at or taken[at - 1][1] <= a):
                        out.append((KINDS[best[i] - 1], a, b))
                i = j
        return out


def disjoint(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that any span covers, in order, overlaps joined."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _token_labels(spans: list[tuple[int, int]], base: list[Span]) -> list[int]:
    return [next((1 + KINDS.index(k) for k, c, d in base if c < b and a < d), 0) for a, b in spans]


def train(texts: list[str], steps: int = 150, rate: float = 0.5, ridge: float = 1e-3, agreement: float = 4.0) -> Field:
    """Learn from base spans: token weights by logistic regression, chain weights from label pairs.

    The skip potential rewards a shared label by ``agreement``, for kinds only. Without any text nothing is learned and all is outside.
    """
    feats, many, labels, pairs = array("i"), [], [], np.ones((len(LABELS), len(LABELS)))
    for text in texts:
        base = base_spans(text)
        for spans in _near_tokens(text):
            tokens = [text[a:b] for a, b in spans]
            y = _token_labels(spans, base)
            for i in range(len(tokens)):
                f = _features(tokens, i)
                feats.extend(f)
                many.append(len(f))
            labels += y
            np.add.at(pairs, (y[:-1], y[1:]), 1)
    unary = np.zeros((BUCKETS, len(LABELS)))
    if feats:
        n = len(many)
        row = np.repeat(np.arange(n), many)
        col = np.frombuffer(feats, np.int32)
        y = np.eye(len(LABELS))[labels]
        scale = 1 / np.maximum(1, np.bincount(col, minlength=BUCKETS)) ** 0.5
        for _ in range(steps):
            z = np.stack([np.bincount(row, unary[col, k], n) for k in range(len(LABELS))], 1)
            p = np.exp(z - np.logaddexp.reduce(z, axis=1)[:, None])
            for k in range(len(LABELS)):
                unary[:, k] -= rate * (np.bincount(col, (p - y)[row, k], BUCKETS) * scale / 4 + ridge * unary[:, k])
    else:
        unary[:, 0] = 1.0
    chain = np.log(pairs / pairs.sum(1, keepdims=True) / (pairs.sum(0) / pairs.sum()))
    skip = np.diag([0.0] + [agreement] * len(KINDS))
    return Field(unary, np.clip(chain, -2, 2), skip)


MOST_TRAINING_TEXTS = 3_000


def fit(docs: DataFrame, text: str = "text", most: int = MOST_TRAINING_TEXTS) -> Field:
    """Train on at most ``most`` texts that hold a digit or an ``@``, those with the smallest hashes.

    Only the windows around marks of each text (see ``_near_tokens``) go to the driver, all of them and whole.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                out.append("\n\n\n".join(t[s[0][0] : s[-1][1]] for s in _near_tokens(t)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])

    some = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    edge = some.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if edge is None:
        return train([])
    rows = some.where(F.col("h") <= F.lit(edge)).dropDuplicates(["h"]).select("t").mapInArrow(lean(windows), "w string").collect()
    return train(sorted(r["w"] for r in rows))


_MARKS = byte_class([(0x30, 0x39), (0x40, 0x40)])


def find_pii(df: DataFrame, model: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row its key, counts of base spans by kind, their SHA-256, all spans, how many the field added, and how many there are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            rows = []
            for a, b, data, offsets in chunks(batch.column(1)):
                marked = np.concatenate([[0], np.cumsum(_MARKS[data])])
                has = marked[offsets[1:]] > marked[offsets[:-1]]
                for i in range(b - a):
                    if not has[i]:
                        rows.append((0, 0, 0, 0, empty, "", 0, 0))
                        continue
                    t = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    base = base_spans(t)
                    more = field.added(t, base)
                    n = defaultdict(int)
                    for k, _, _ in base:
                        n[k] += 1
                    rows.append((*(n[k] for k in KINDS), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more), len(more), len(base) + len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(df: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; overlapping spans by the first's. Null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def clean(t: str) -> str:
        base = base_spans(t)
        spans = sorted(base + shared.value.added(t, base), key=lambda s: (s[1], -s[2]))
        out, at = [], 0
        for k, a, b in spans:
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = [t if t is None or not _TRIGGER.search(t) else clean(t) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    return df.mapInArrow(lean(run), df.schema)
