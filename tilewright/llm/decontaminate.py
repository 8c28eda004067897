"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. An item's windows are its runs
of 13 consecutive words, or the whole item if it has fewer words but some. A document word inside an occurrence of
any window is hit. Null has no words; items without words have no window.

1. Terms of the windows are counted over all documents (partial sums per task, one small row a term).
2. Each window is anchored at its rarest term. The index stores a posting (document, term, position) for every
   occurrence of an anchor, with the words around it as far as a window reaches. It is kept in the shared folder.
3. A window's list begins with its anchor's postings, adjusted by the anchor's offset; the stored neighbours take
   the place of the other terms' lists, so each further term is met at its own offset without another shuffle.

Documents are told apart by id and text: repeated rows get the same result each. The windows are broadcast after
their bytes are counted and found below ``BROADCAST_BYTES``; beyond that the same joins run without the hint, as
shuffled joins that Spark may split where a term is hot. What grows with a document's own length stays inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

WINDOW = 13
BROADCAST_BYTES = 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased; in plain ASCII that is lower(), which is faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words as an array; empty for null."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, width: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (words) with the ids, as strings, of the items that have them."""
    w = items.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window"))
    return w.groupBy("window").agg(F.collect_set("item").alias("items"))


def broadcastable(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted bytes are within the limit."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each of ``terms`` (term) in all documents; those that never occur are left out."""
    seen = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    return seen.join(broadcastable(terms, F.octet_length("term") + 16), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, uses): for each anchor the windows it is the rarest term of, with its offset in each.

    A window with a term that no document has cannot occur and is dropped. Equally rare terms: the first by spelling.
    """
    at = windows.select("window", "items", F.posexplode("window").alias("offset", "term")).join(counts, "term", "left")
    best = at.groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("term"), F.col("offset"))).alias("a"))
    best = best.where("a.n > 0")
    return best.groupBy(F.col("a.term").alias("term")).agg(F.collect_list(F.struct(F.col("a.offset").alias("offset"), "window", "items")).alias("uses"))


def build_index(docs: DataFrame, anchors: DataFrame, width: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc, hash, term, pos, first, near) of the anchors; ``near`` has the words around, from place ``first``."""
    terms = broadcastable(anchors.select("term"), F.octet_length("term") + 16)
    w = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), words_of(F.col(text)).alias("w"))
    at = w.select("doc", "hash", "w", F.posexplode("w").alias("pos", "term")).join(terms, "term")
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    return at.select("doc", "hash", "term", "pos", first.alias("first"), F.slice("w", first + 1, F.col("pos") + width - first).alias("near"))


def phrase_hits(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, hash, hits): per document the exact occurrences, arrays of (start, size, items), one entry an anchor's posting."""
    size = F.aggregate("uses", F.lit(0), lambda a, u: a + 200 + F.size(u["window"]) * 16 + F.size(u["items"]) * 24)
    both = index.join(broadcastable(anchors, size), "term")

    def occurs(use: Column) -> Column:
        start = F.col("pos") - use["offset"]
        return (start >= 0) & (F.slice(F.col("near"), F.greatest(start - F.col("first"), F.lit(0)) + 1, F.size(use["window"])) == use["window"])

    found = F.transform(F.filter("uses", occurs), lambda u: F.struct((F.col("pos") - u["offset"]).alias("start"), F.size(u["window"]).alias("size"), u["items"].alias("items")))
    both = both.select("doc", "hash", found.alias("found")).where(F.size("found") > 0)
    return both.groupBy("doc", "hash").agg(F.flatten(F.collect_list("found")).alias("hits"))


def near_hits(docs: DataFrame, items: DataFrame, counts: DataFrame, terms: int = 3, distance: int = 20, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Proximity matches: (doc, hash, item) where the item's ``terms`` rarest distinct terms stand within ``distance`` words.

    Each posting of the rarest term looks for the others among its stored neighbours. Items with fewer distinct terms need all of theirs.
    """
    t = items.select(F.col(item).cast("string").alias("item"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).join(counts, "term", "left")
    t = t.groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("term")))), 1, terms).alias("r"))
    t = t.where(F.col("r")[0]["n"] > 0).select("item", F.col("r")[0]["term"].alias("term"), F.col("r.term").alias("all"))
    index = build_index(docs, t.select("term").distinct(), distance, key)
    both = index.join(broadcastable(t, F.lit(200)), "term")
    return both.where(F.size(F.array_except("all", "near")) == 0).select("doc", "hash", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: key, hash, n_words, n_hit, n_items, items_sha256, contaminated (1 hit word in 20 or more)."""
    windows = cut(item_windows(items, width))
    counts = cut(term_counts(docs, windows.select(F.explode("window").alias("term")).distinct(), text))
    anchors = cut(anchored(windows, counts))
    index = cut(build_index(docs, anchors, width, key, text))
    hits = phrase_hits(index, anchors)
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["size"]).alias("end")))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(spans, start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")))["n"]
    hits = hits.select("doc", "hash", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("hits.items"))).alias("items"))
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    out = rows.join(hits.withColumnsRenamed({"doc": "doc_", "hash": "hash_"}), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("hash") == F.col("hash_")), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc").alias(key), F.col("hash"), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, i, i + 12) AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
dg AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dg.doc_id, dg.i, dg.n, win.item FROM dg JOIN win ON dg.g = win.g AND dg.n = len(win.g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
