"""Filter interaction audit by Walsh-Hadamard sums: what each of several filters removes in every order of them.

A row's failures are a mask of as many bits as there are filters. Per part and class of rows (all, good, toxic) the
sums of (-1) to the number of bits that mask and u share, over all masks u, are added up on Spark; they are linear,
so rows may come in pieces and with weights, and no row travels beyond its task but as these sums. The inverse
transform gives the exact number of rows of each mask, and from these follow, for each order and step, the rows kept,
removed, removed before, failing only here, and the good and toxic rows lost; and in closed form the rows that a
filter removes over all orders, as a row that fails k filters is removed by each of them in (orders / k) orders.

Filters of ``text_failures``: A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] > 2 * characters;
D any of ``#$%&*|``. ``E`` fails where a smaller key of the whole table has an identical text. Words are maximal
``[^\\x20\\x09-\\x0D]+``, case-sensitive. Null texts are empty texts, null parts the empty string. Repeated rows count
as often as they stand; rows of one key do not fail E by each other, and a null key is neither smaller nor larger
than another. Several labels of a key: good or toxic if any says so. An empty table has no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

FILTERS = "ABCDE"
CLASSES = ("all", "good", "toxic")


def text_failures(text: Column) -> Column:
    """The mask of the filters A to D (bits 1, 2, 4, 8) that a text fails."""
    t = F.coalesce(text, F.lit(""))
    w = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    upper = F.regexp_count(t, F.lit("[A-Z]")).cast("long")
    failures = [n < 200, 100 * distinct.cast("long") < 50 * n, 100 * upper > 2 * F.length(t), t.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for bit, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def counted_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, same, part, mask, n, good, toxic): rows of a key and part with their number; ``same`` stands for the text.

    Texts stay in their tasks: what is shuffled is a digest of each, and rows that agree are added up before.
    """
    rows = docs.select(F.col(key).alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("same"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(F.col(text)).alias("mask"))
    rows = rows.groupBy("key", "same", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(said, "key", "left")
    return rows.select("key", "same", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def with_repeats(rows: DataFrame, bit: int = 16) -> DataFrame:
    """(part, mask, n, good, toxic) with weights n: every keyed row as failing ``bit``, and, of each text, the rows of the
    smallest key once as not failing and once less as failing. The sums of masks need no more than these weights."""
    keyed = rows.where("key is not null")
    least = keyed.groupBy(F.col("same").alias("same_")).agg(F.min("key").alias("key_"))
    first = keyed.join(least, (F.col("same") == F.col("same_")) & (F.col("key") == F.col("key_")), "left_semi")
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("n")), F.struct((F.col("mask") + bit).alias("mask"), (-F.col("n")).alias("n")))).alias("x")
    names = ["part", "mask", "n", "good", "toxic"]
    out = rows.withColumn("mask", F.col("mask") + F.when(F.col("key").isNull(), 0).otherwise(bit)).select(*names)
    return out.unionAll(first.select("part", both, "good", "toxic").select("part", "x.mask", "x.n", "good", "toxic"))


def _sign(u: Column, mask: Column) -> Column:
    return 1 - 2 * (F.bit_count(u.bitwiseAND(mask)) % 2)


def parity_sums(rows: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """(part, class, sums): for each mask u the sum of n * (-1)^|mask & u| over the rows of a part and class."""
    classes = F.array_compact(F.array(F.lit(CLASSES[0]), *(F.when(F.col(c) == 1, F.lit(c)) for c in CLASSES[1:])))
    rows = rows.select("part", "mask", "n", F.explode(classes).alias("class"))
    sums = [F.sum(F.col("n") * _sign(F.lit(u), F.col("mask"))).alias(f"s{u}") for u in range(1 << bits)]
    return rows.groupBy("part", "class").agg(*sums).select("part", "class", F.array(*(f"s{u}" for u in range(1 << bits))).alias("sums"))


def mask_cells(sums: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """(part, all, good, toxic): arrays of the number of rows by mask, by the inverse transform."""
    masks = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    signed = F.transform(masks, lambda m: F.aggregate(F.zip_with(masks, "sums", lambda u, s: s * _sign(u, m)), F.lit(0).cast("long"), lambda a, x: a + x))
    cells = sums.select("part", "class", F.transform(signed, lambda x: F.shiftright(x, bits)).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << bits)
    return cells.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("class") == c, F.col("cells"))), none).alias(c) for c in CLASSES))


def order_steps(filters: str = FILTERS) -> Column:
    """An array of all steps of all orders: filter_order, step (from 1), the filter's bit and the mask of those before."""
    steps = []
    for order in permutations(sorted(filters)):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << filters.index(name)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*steps)


def evaluate_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step the counts of the module's head."""
    orders = 1
    for k in range(2, len(filters) + 1):
        orders *= k
    masks = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))

    def total(name: str, weight) -> Column:
        return F.aggregate(F.zip_with(masks, name, lambda m, c: c * weight(m)), F.lit(0).cast("long"), lambda a, x: a + x)

    def where(condition) -> Column:
        return lambda m: F.when(condition(m), 1).otherwise(0)

    bit, before = F.col("s.bit"), F.col("s.before")
    fails, gone = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = where(lambda m: fails(m) & ~gone(m))
    share = lambda m: F.when(fails(m), F.floor(F.lit(orders) / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0)
    return cells.withColumn("s", F.explode(order_steps(filters))).select(
        "part", "s.filter_order", "s.step",
        total("all", where(lambda m: ~fails(m) & ~gone(m))).alias("kept"), total("all", removed).alias("removed"),
        total("all", where(lambda m: fails(m) & gone(m))).alias("redundant"), total("all", where(lambda m: m == bit)).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("all", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The five filters in all their orders, per part; columns as in ``evaluate_orders``. Shapley shares are whole:
    120 is divided by each number of failures."""
    rows = cut(counted_rows(docs, labels, key, text, part))
    return evaluate_orders(mask_cells(parity_sums(with_repeats(rows))))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(source AS VARCHAR), '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
y AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS here,
    length(translate(before, fails, '')) < length(before) AS gone
  FROM g, s),
z AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM y GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM z
"""
