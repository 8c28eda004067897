"""Joins, searches, selections, summaries and the evaluator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.sequence import digest_bases
from ..operators import annotation as A
from ..operators import alignment, intervals, recovery, search, seeds, selection, summary, units
from ..operators import windows as W
from ..session import tasks_for
from .base import PARTS, Tables, bases_sql, dealt_parts, long, parts, query, rc_sql, six

# --- annotation and interval algebra


@query("c1_segment_selection", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln FROM (SELECT *, max(CAST(l_linenumber % 3 = 0 AS INT)) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE (c = 1 AND l_linenumber % 3 = 0) OR c = 0")
def c1(t: Tables) -> DataFrame:
    seg = t.lineitem.withColumn("type", F.when(F.col("l_linenumber") % 3 == 0, "CDS").otherwise("exon"))
    return A.select_segments(seg, "l_orderkey", "type", "CDS").select("l_orderkey", long("l_linenumber", "ln"))


@query("c2_transcript_choice", "SELECT p_brand AS gene, arg_min(p_partkey, (CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END) * 100000000 + p_partkey) AS transcript FROM part WHERE p_size % 4 = 0 OR p_size % 4 = 1 GROUP BY p_brand")
def c2(t: Tables) -> DataFrame:
    tags = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("basic"), F.lit("MANE_Select"))).when(F.col("p_size") % 4 == 1, F.array(F.lit("Ensembl_canonical"))).otherwise(F.array(F.lit("basic")))
    return A.choose_transcript(t.part.select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("transcript"), tags.alias("tags")), "gene", "transcript", "tags", "mane")


@query("c3_version_match", """
WITH w AS (SELECT 'P' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '.7' END AS wanted FROM part),
k AS (SELECT 'P' || p_partkey || '.1' AS known FROM part UNION ALL SELECT 'P' || p_partkey || '.2' FROM part WHERE p_partkey % 5 = 0),
b AS (SELECT regexp_replace(known, '\\.\\d+$', '') AS b, min(known) AS known FROM k GROUP BY 1 HAVING count(*) = 1)
SELECT wanted, known FROM w JOIN k ON wanted = known UNION ALL
SELECT wanted, b.known FROM w JOIN b ON regexp_replace(wanted, '\\.\\d+$', '') = b.b WHERE wanted NOT IN (SELECT known FROM k)""")
def c3(t: Tables) -> DataFrame:
    p = F.concat(F.lit("P"), F.col("p_partkey"))
    wanted = t.part.select(F.concat(p, F.when(F.col("p_partkey") % 2 == 0, ".1").otherwise(".7")).alias("wanted"))
    known = t.part.select(F.concat(p, F.lit(".1")).alias("known")).unionAll(t.part.where("p_partkey % 5 = 0").select(F.concat(p, F.lit(".2")).alias("known")))
    return A.match_ids(wanted, known, "wanted", "known")


@query("c4_restrict_transcripts", "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem WHERE (l_orderkey, l_partkey) IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0) OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0)")
def c4(t: Tables) -> DataFrame:
    pairs = t.lineitem.where("l_linenumber = 1 and l_orderkey % 2 = 0").select("l_orderkey", "l_partkey").distinct()
    return A.restrict_to(t.lineitem.select("l_orderkey", "l_partkey", long("l_linenumber", "ln")), pairs, "l_orderkey", "l_partkey")


@query("c5_segment_merge", "SELECT l_suppkey, l_returnflag, count(*) AS n_trans, CAST(count(DISTINCT l_partkey) AS BIGINT) AS names, CAST(min(l_partkey) AS BIGINT) AS first FROM lineitem GROUP BY ALL")
def c5(t: Tables) -> DataFrame:
    m = A.merge_segments(t.lineitem, ["l_suppkey", "l_returnflag"], "l_partkey")
    return m.select("l_suppkey", "l_returnflag", "n_trans", long(F.size("transcript_names"), "names"), F.col("transcript_names")[0].alias("first"))


_DAYS = "(SELECT * FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS e FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY s, e, l_suppkey, l_partkey, l_returnflag) = 1)"


def days(t: Tables) -> DataFrame:
    """Line items as intervals of days; of rows with equal keys the smallest, so that row_id is unique.

    Dealt by key first: hardly any two rows have one key, so a partial minimum would sort a whole split for nothing.
    """
    s = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.struct(s.cast("long").alias("s"), (s + F.col("l_quantity").cast("int")).cast("long").alias("e"), "l_suppkey", "l_partkey", "l_returnflag").alias("x"))
    rows = rows.repartition(tasks_for(t.lineitem), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("x").alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.*", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))


@query("c6_w6_w7_merged_offsets", f"""
WITH a AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber) = 1 THEN 1 ELSE 0 END AS nw FROM {_DAYS}),
b AS (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber) AS blk FROM a),
k AS (SELECT l_suppkey, blk, min(s) AS bs, max(e) AS be FROM b GROUP BY ALL),
o AS (SELECT *, sum(be - bs + 1) OVER (PARTITION BY l_suppkey ORDER BY blk) - (be - bs + 1) AS bo FROM k)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, CAST(bs AS BIGINT) AS block_start, CAST(bo + s - bs AS BIGINT) AS off FROM b JOIN o USING (l_suppkey, blk)""")
def c6(t: Tables) -> DataFrame:
    return A.merged_offsets(days(t), ["l_suppkey"], "s", "e").select("l_orderkey", long("l_linenumber", "ln"), "block_start", long("offset", "off"))


@query("c7_transcript_splicing", f"SELECT l_orderkey, string_agg(substr(seq, 1, 4), '' ORDER BY l_linenumber, substr(seq, 1, 4)) AS seq FROM lineitem JOIN {PARTS} p ON p_partkey = l_partkey GROUP BY l_orderkey")
def c7(t: Tables) -> DataFrame:
    rows = t.lineitem.join(parts(t), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", F.substring("seq", 1, 4).alias("seq"))
    return A.splice(rows, ["l_orderkey"], "l_linenumber", "seq")


@query("c7_conversation_splicing", "SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS seq FROM conversations GROUP BY conv_id")
def c7b(t: Tables) -> DataFrame:
    return A.splice(t.conversations.select("conv_id", "turn", F.col("text").alias("seq")), ["conv_id"], "turn", "seq")


@query("c8_target_validation", "SELECT o_custkey % 2000 AS k, bool_or(c_custkey IS NOT NULL) AS valid FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey % 2000 GROUP BY 1")
def c8(t: Tables) -> DataFrame:
    return A.validate(t.orders.select((F.col("o_custkey") % 2000).alias("k")).distinct(), t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")), "k")


@query("c10_utr_sides", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, CAST(CASE WHEN (s < 1000) = (l_suppkey % 2 = 0) THEN 5 ELSE 3 END AS BIGINT) AS utr_side FROM {_DAYS}")
def c10(t: Tables) -> DataFrame:
    d = days(t).withColumns({"strand": F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-"), "cds": F.lit(1000)})
    return A.utr_side(d, "l_suppkey", "strand", "s", "cds").select("l_orderkey", long("l_linenumber", "ln"), long("utr_side", "utr_side"))


_ORD = "(SELECT o_orderkey, o_custkey, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS os FROM orders)"


def order_days(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("os")).withColumn("oe", F.col("os") + 3)


@query("l3_g7_interval_overlap", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, count(*) AS n FROM {_DAYS} l JOIN {_ORD} o ON o_custkey % 100 + 1 = l_suppkey AND os < e AND s < os + 3 WHERE s < e GROUP BY ALL")
def l3(t: Tables) -> DataFrame:
    right = order_days(t).withColumn("l_suppkey", F.col("o_custkey") % 100 + 1).drop("o_orderkey")
    out = intervals.overlap_join(days(t), right, ["l_suppkey"], "s", "e", "os", "oe", 30)
    return out.groupBy("l_orderkey", long("l_linenumber", "ln")).agg(F.count("*").alias("n"))


@query("l4_interval_containment", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, count(*) AS n FROM {_DAYS} l JOIN {_ORD} o ON o_custkey % 100 + 1 = l_suppkey AND os >= s AND os + 3 <= e GROUP BY ALL")
def l4(t: Tables) -> DataFrame:
    right = order_days(t).withColumn("l_suppkey", F.col("o_custkey") % 100 + 1).drop("o_orderkey")
    out = intervals.within_join(days(t), right, ["l_suppkey"], "s", "e", "os", "oe", 30)
    return out.groupBy("l_orderkey", long("l_linenumber", "ln")).agg(F.count("*").alias("n"))


@query("a8_mask_anti_join", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln FROM {_DAYS} l WHERE NOT EXISTS (SELECT 1 FROM {_ORD} o WHERE o_custkey % 100 + 1 = l_suppkey AND os < e AND s < os + 3 AND s < e)")
def a8(t: Tables) -> DataFrame:
    right = order_days(t).withColumn("l_suppkey", F.col("o_custkey") % 100 + 1).drop("o_orderkey")
    out = intervals.without_overlap(days(t), right, ["l_suppkey"], "s", "e", "os", "oe", 30, ["row_id"])
    return out.select("l_orderkey", long("l_linenumber", "ln"))


# --- similarity search

_Q = f"(SELECT s_suppkey, substr(b, 1, CAST(s_suppkey % 12 + 5 AS INT)) || translate(substr(b, CAST(s_suppkey % 12 + 6 AS INT), 1), 'ACGT', 'CGTA') || substr(b, CAST(s_suppkey % 12 + 7 AS INT)) AS q FROM (SELECT s_suppkey, substr({bases_sql('s_suppkey')}, 3, 18) AS b FROM supplier))"
_R = f"(SELECT p_brand || '_' || p_partkey AS record, {bases_sql('p_partkey')} AS r FROM part)"


def oligos(t: Tables) -> DataFrame:
    """18-mers of parts' sequences, each with one base replaced."""
    b = F.substring(digest_bases("s_suppkey"), 3, 18)
    at = (F.col("s_suppkey") % 12 + 6).cast("int")
    return t.supplier.select("s_suppkey", F.concat(F.substring(b, F.lit(1), at - 1), F.translate(F.substring(b, at, F.lit(1)), "ACGT", "CGTA"), F.substring(b, at + 1, F.lit(18))).alias("q"))


def records(t: Tables) -> DataFrame:
    return t.part.select(F.concat_ws("_", "p_brand", "p_partkey").alias("record"), digest_bases("p_partkey").alias("r"))


def sites(t: Tables, strand: str = "sense", mismatches: int = 2) -> DataFrame:
    return search.mismatch_sites(oligos(t), records(t), "q", "record", "r", mismatches, strand)


_SITES = f"(SELECT DISTINCT q AS query, '+' AS strand, record, CAST(i AS BIGINT) AS start0, hamming(q, substr(r, CAST(i AS INT) + 1, 18)) AS mismatches FROM {_Q} q, {_R} r, generate_series(0, 14) x(i) WHERE hamming(q, substr(r, CAST(i AS INT) + 1, 18)) <= 2)"


@query("e1_l5_mismatch_sites", f"SELECT query, record, start0, CAST(mismatches AS BIGINT) AS mismatches FROM {_SITES}")
def e1(t: Tables) -> DataFrame:
    return sites(t).select("query", "record", long("start0", "start0"), long("mismatches", "mismatches"))


@query("e1_both_strands", f"SELECT DISTINCT q AS query, s AS strand, record, CAST(i AS BIGINT) AS start0 FROM (SELECT q, '+' AS s, q AS w FROM {_Q} UNION ALL SELECT q, '-', {rc_sql('q')} FROM {_Q}), {_R} r, generate_series(0, 14) x(i) WHERE hamming(w, substr(r, CAST(i AS INT) + 1, 18)) <= 1")
def e1b(t: Tables) -> DataFrame:
    return sites(t, "both", 1).select("query", "strand", "record", long("start0", "start0"))


@query("e1_e3_e7_indexed_sites", f"SELECT query, split_part(record, '_', 1) AS gene, CAST(min(mismatches) AS BIGINT) AS mismatches, CAST(any_value(n) AS BIGINT) AS mapped_sites_num FROM (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM {_SITES}) GROUP BY 1, 2")
def e1_indexed(t: Tables) -> DataFrame:
    """Two attributes of the same oligos from one index of the records."""
    hits = seeds.indexed_sites(oligos(t), seeds.write_index(records(t), "record", "r", 9), "q", 2)
    return search.fewest_mismatches(hits).join(search.site_lists(hits), "query").select("query", "gene", long("mismatches", "mismatches"), "mapped_sites_num")


@query("e2_heuristic_sites")
def e2(t: Tables) -> DataFrame:
    """An approximation by design; see the operator."""
    whole = t.part.select(digest_bases("p_partkey").alias("q"))
    return search.heuristic_sites(whole, records(t), "q", "record", "r")


@query("e2_gapped_local_sites")
def e2_gapped(t: Tables) -> DataFrame:
    """Each part's bases without the 16th, on both strands: every one has a site with a gap in its own record."""
    short = t.part.select(F.concat(F.substring(digest_bases("p_partkey"), 1, 15), F.substring(digest_bases("p_partkey"), 17, 16)).alias("q"))
    return alignment.local_sites(short, records(t), "q", "record", "r", "both")


@query("e3_site_lists", f"SELECT query, count(*) AS mapped_sites_num, string_agg(record || ':' || start0, ';' ORDER BY record, start0) AS mapped FROM {_SITES} GROUP BY query")
def e3(t: Tables) -> DataFrame:
    out = search.site_lists(sites(t))
    return out.select("query", "mapped_sites_num", F.array_join(F.transform("mapped_sites", lambda x: F.concat_ws(":", x["record"], x["start0"])), ";").alias("mapped"))


_KM = "(SELECT least(k, " + rc_sql("k") + f") AS kmer, count(*) AS n FROM (SELECT substr(r, CAST(i AS INT), 7) AS k FROM {_R}, generate_series(1, 26) x(i)) GROUP BY 1)"


@query("e4_kmer_count", f"SELECT s_suppkey, CAST(max(coalesce(n, 0)) AS BIGINT) AS kmer_count FROM (SELECT s_suppkey, least(substr(q, CAST(i AS INT), 7), {rc_sql('substr(q, CAST(i AS INT), 7)')}) AS kmer FROM {_Q}, generate_series(1, 12) x(i)) LEFT JOIN {_KM} USING (kmer) GROUP BY s_suppkey")
def e4(t: Tables) -> DataFrame:
    return search.max_kmer_count(oligos(t), records(t), "q", "r", 7).select("s_suppkey", long("kmer_count", "kmer_count"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_AS_BASES = ("ACGT" * 13)[:52]


@query("e4_long_kmer_spectrum", f"""
WITH d AS (SELECT translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_AS_BASES}') AS s FROM documents),
k AS (SELECT substr(s, CAST(i AS INT), 24) AS k FROM d, unnest(generate_series(1, length(s) - 23)) x(i) WHERE length(s) >= 24),
c AS (SELECT least(k, {rc_sql('k')}) AS kmer, count(*) AS n FROM k GROUP BY 1)
SELECT n, count(*) AS kmers FROM c GROUP BY n""")
def e4_long(t: Tables) -> DataFrame:
    """How many words of 24 bases occur n times in all documents, whose letters stand for bases."""
    texts = t.documents.select(F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), _LETTERS, _AS_BASES).alias("s"))
    return search.kmer_table(texts, "s", 24).groupBy(long("n", "n")).agg(F.count("*").alias("kmers"))


@query("e5_locus_kmer_count", f"SELECT s_suppkey, CAST(max(coalesce(n, 0)) AS BIGINT) AS kmer_count FROM (SELECT s_suppkey, least(substr(q, CAST(i AS INT), 7), {rc_sql('substr(q, CAST(i AS INT), 7)')}) AS kmer FROM {_Q}, generate_series(1, 12) x(i)) LEFT JOIN {_KM} USING (kmer) GROUP BY s_suppkey")
def e5(t: Tables) -> DataFrame:
    return search.max_kmer_count(oligos(t), records(t), "q", "r", 7, restrict=True).select("s_suppkey", long("kmer_count", "kmer_count"))


@query("e6_kmer_threshold", f"SELECT kmer_count // 5 AS bin, count(*) AS n FROM (SELECT s_suppkey, max(coalesce(n, 0)) AS kmer_count FROM (SELECT s_suppkey, least(substr(q, CAST(i AS INT), 7), {rc_sql('substr(q, CAST(i AS INT), 7)')}) AS kmer FROM {_Q}, generate_series(1, 12) x(i)) LEFT JOIN {_KM} USING (kmer) GROUP BY s_suppkey) WHERE kmer_count < 20 GROUP BY 1")
def e6(t: Tables) -> DataFrame:
    kept = search.max_kmer_count(oligos(t), records(t), "q", "r", 7).where("kmer_count < 20")
    return kept.groupBy(F.floor(F.col("kmer_count") / 5).alias("bin")).agg(F.count("*").alias("n"))


@query("e7_gene_minima", f"SELECT query, split_part(record, '_', 1) AS gene, CAST(min(mismatches) AS BIGINT) AS mismatches FROM {_SITES} GROUP BY 1, 2")
def e7(t: Tables) -> DataFrame:
    return search.fewest_mismatches(sites(t)).select("query", "gene", long("mismatches", "mismatches"))


_HALF = f"(SELECT p_partkey, substr({bases_sql('p_partkey')}, 1, 10) AS a, substr({bases_sql('p_partkey')}, 15, 10) AS b FROM part)"


@query("e8_l6_oligo_units", f"""
WITH h AS (SELECT p_partkey AS unit, w, record, i, hamming(w, substr(r, CAST(i AS INT) + 1, 10)) AS m FROM (SELECT p_partkey, a AS w, 0 AS o FROM {_HALF} UNION ALL SELECT p_partkey, b, 1 FROM {_HALF}), {_R} r, generate_series(0, 22) x(i) WHERE hamming(w, substr(r, CAST(i AS INT) + 1, 10)) <= 1),
b AS (SELECT unit, record, w, min(m) AS m FROM h GROUP BY ALL)
SELECT unit, record, CAST(max(m) AS BIGINT) AS mismatches FROM b GROUP BY unit, record HAVING count(*) = 2""")
def e8(t: Tables) -> DataFrame:
    return oligo_units(t)


def oligo_units(t: Tables, gap: int | None = None) -> DataFrame:
    half = t.part.select(F.col("p_partkey").alias("unit"), F.explode(F.array(F.substring(digest_bases("p_partkey"), 1, 10), F.substring(digest_bases("p_partkey"), 15, 10))).alias("w"))
    return units.short_units(half, records(t), "unit", "w", "record", "r", 1, gap).select("unit", "record", long("mismatches", "mismatches"))


@query("e8_oligo_units_with_gap", f"""
WITH h AS (SELECT p_partkey AS unit, o, w, record, i, hamming(w, substr(r, CAST(i AS INT) + 1, 10)) AS m FROM (SELECT p_partkey, a AS w, 0 AS o FROM {_HALF} UNION ALL SELECT p_partkey, b, 1 FROM {_HALF}), {_R} r, generate_series(0, 22) x(i) WHERE hamming(w, substr(r, CAST(i AS INT) + 1, 10)) <= 1)
SELECT x.unit, x.record, CAST(min(greatest(x.m, y.m)) AS BIGINT) AS mismatches FROM h x JOIN h y ON x.unit = y.unit AND x.record = y.record AND x.w < y.w
WHERE (y.i >= x.i + 10 AND y.i - x.i - 10 <= 6) OR (x.i >= y.i + 10 AND x.i - y.i - 10 <= 6) GROUP BY 1, 2""")
def e8b(t: Tables) -> DataFrame:
    return oligo_units(t, 6)


@query("e9_e12_e15_e16_annotation", """
WITH h AS (SELECT DISTINCT l_orderkey AS query, 'g' || l_suppkey AS gene, l_linenumber % 3 AS mm, l_linenumber AS ln FROM lineitem),
m AS (SELECT query, gene, min(mm) AS mm FROM h GROUP BY 1, 2),
own AS (SELECT query, min(gene) AS gene, min(gene) AS target FROM h GROUP BY query),
x AS (SELECT 'g' || s_suppkey AS gene, s_acctbal AS v FROM supplier WHERE s_suppkey % 4 <> 0),
j AS (SELECT m.query, own.target, m.gene, mm, m.gene = own.gene AS o, x.v, coalesce(tx.v, 0) AS tv FROM m JOIN own ON own.query = m.query LEFT JOIN x ON x.gene = m.gene LEFT JOIN x tx ON tx.gene = own.gene),
k AS (SELECT *, CASE WHEN o THEN 'own' WHEN v IS NOT NULL AND v < greatest(1000e0, tv * 0.5e0) THEN 'low' ELSE 'off' END AS kind FROM j)
SELECT query, target, CAST(max(CAST(kind = 'own' AS INT)) + count(*) FILTER (WHERE kind = 'off') AS BIGINT) AS mapped_genes, coalesce(string_agg(gene || ':' || mm, ', ' ORDER BY mm, gene) FILTER (WHERE kind = 'off'), '') AS off_targets, coalesce(string_agg(gene || ':' || mm, ', ' ORDER BY mm, gene) FILTER (WHERE kind = 'low'), '') AS unexpressed
FROM k GROUP BY query, target""")
def e9(t: Tables) -> DataFrame:
    h = t.lineitem.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("g"), F.col("l_suppkey")).alias("gene"), (F.col("l_linenumber") % 3).alias("mismatches")).groupBy("query", "gene").agg(F.min("mismatches").alias("mismatches"))
    own = h.groupBy("query").agg(F.min("gene").alias("gene")).withColumn("target", F.col("gene"))
    expr = t.supplier.where("s_suppkey % 4 <> 0").select(F.concat(F.lit("g"), F.col("s_suppkey")).alias("gene"), F.col("s_acctbal").alias("value"))
    labels = t.supplier.select(F.concat(F.lit("g"), F.col("s_suppkey")).alias("gene")).withColumn("label", F.col("gene"))
    return search.annotate(h, own, labels, expr, 1000, 0.5).select("query", "target", "mapped_genes", "off_targets", "unexpressed")


@query("e10_w12_gene_labels", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '(' || p_partkey || ')' ELSE p_name END AS label FROM part")
def e10(t: Tables) -> DataFrame:
    g = t.part.select(F.col("p_partkey").cast("string").alias("k"), "p_name", "p_partkey")
    return search.gene_labels(g, "k", "p_name").select(F.col("k").cast("long").alias("p_partkey"), "label")


@query("e13_l1_expression_lookup", """
WITH v AS (SELECT regexp_replace(id, '\\.\\d+$', '') AS id, max(v) AS v FROM (SELECT 'K' || s_suppkey || '.' || s_nationkey AS id, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_name, s_acctbal + 1 FROM supplier WHERE s_suppkey % 3 <> 1) GROUP BY 1)
SELECT s_suppkey, round(coalesce(a.v, b.v), 6) AS value FROM supplier LEFT JOIN v a ON a.id = 'K' || s_suppkey LEFT JOIN v b ON b.id = s_name""")
def e13(t: Tables) -> DataFrame:
    ids = t.supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("K"), F.col("s_suppkey"), F.lit("."), F.col("s_nationkey")).alias("id"), F.col("s_acctbal").alias("v"))
    names = t.supplier.where("s_suppkey % 3 <> 1").select(F.col("s_name").alias("id"), (F.col("s_acctbal") + 1).alias("v"))
    wanted = t.supplier.select("s_suppkey", F.concat(F.lit("K"), F.col("s_suppkey"), F.lit(".9")).alias("key"), "s_name")
    return search.expression_values(wanted, ids.unionAll(names), "key", "s_name", "id", "v").select("s_suppkey", six("value", "value"))


@query("e14_transcript_expression", f"SELECT query, split_part(record, '_', 1) AS gene, CAST(sum(p_size) AS BIGINT) AS value FROM {_SITES} JOIN part ON split_part(record, '_', 2) = CAST(p_partkey AS VARCHAR) GROUP BY 1, 2")
def e14(t: Tables) -> DataFrame:
    hits = sites(t).select("query", "record").distinct()
    table = t.part.select(F.concat_ws("_", "p_brand", "p_partkey").alias("record"), "p_size")
    return hits.join(table, "record").groupBy("query", search.gene_of(F.col("record")).alias("gene")).agg(F.sum("p_size").alias("value"))


@query("e14_transcript_values", f"""
WITH h AS (SELECT DISTINCT query, split_part(record, '_', 1) AS gene, split_part(record, '_', 2) AS transcript FROM {_SITES}),
x AS (SELECT p_partkey || '.1' AS id, p_size AS v FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey || '.2', p_size + 1 FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey || '', p_size * 2 FROM part WHERE p_partkey % 7 = 0),
u AS (SELECT split_part(id, '.', 1) AS base, max(v) AS v FROM x GROUP BY 1 HAVING count(*) = 1)
SELECT query, gene, CAST(sum(coalesce(x.v, u.v)) AS DOUBLE) AS value, count(*) FILTER (WHERE coalesce(x.v, u.v) IS NULL) AS missing
FROM h LEFT JOIN x ON x.id = transcript LEFT JOIN u ON u.base = transcript GROUP BY 1, 2""")
def e14_values(t: Tables) -> DataFrame:
    """Every hit, valued by a made table in which some ids have a version, some two, and some are not listed."""
    key = F.col("p_partkey")
    some = [(key % 3 > 0, ".1", F.col("p_size")), (key % 5 == 0, ".2", F.col("p_size") + 1), (key % 7 == 0, "", F.col("p_size") * 2)]
    ids = F.array(*[F.when(test, F.struct(F.concat(key.cast("string"), F.lit(version)).alias("id"), value.alias("value"))) for test, version, value in some])
    table = t.part.select(F.explode(ids).alias("x")).where("x is not null").select("x.*")
    out = search.transcript_values(sites(t), table)
    return out.select("query", "gene", "value", long(F.size("missing"), "missing"))


@query("e17_shared_kmers", f"""
WITH a AS (SELECT DISTINCT s_suppkey AS target, substr(b, CAST(i AS INT), 5) AS kmer FROM (SELECT s_suppkey, {bases_sql('s_suppkey')} AS b FROM supplier), generate_series(1, 28) x(i)),
r AS (SELECT DISTINCT record, substr(r, CAST(i AS INT), 5) AS kmer FROM {_R}, generate_series(1, 28) x(i)),
n AS (SELECT target, count(*) AS n FROM a GROUP BY 1)
SELECT target, record, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS share FROM a JOIN r USING (kmer) JOIN n USING (target) GROUP BY 1, 2 HAVING count(*) >= 4""")
def e17(t: Tables) -> DataFrame:
    targets = t.supplier.select("s_suppkey", digest_bases("s_suppkey").alias("b"))
    out = search.shared_kmers(targets, records(t), "s_suppkey", "b", "record", "r", 5, least=4)
    return out.select("target", "record", six("share", "share"))


@query("e18_window_overlay", f"SELECT p_partkey, substr(seq, 1, 22) || 'NN' || substr(seq, 25, 8) AS seq FROM {PARTS}")
def e18(t: Tables) -> DataFrame:
    w = W.sliding_windows(dealt_parts(t), "seq", 10, None, 4).where("start0 in (0, 4, 8, 12)").select("p_partkey", (F.col("start0") + 1).alias("st"), "window")
    tail = parts(t).select("p_partkey", F.lit(25).alias("st"), F.substring("seq", 25, 8).alias("window"))
    return search.overlay(w.unionAll(tail), "p_partkey", "st", "window")


@query("e19_l2_record_audit", "SELECT p_brand || '_' || p_partkey AS record FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey <= 10)")
def e19(t: Tables) -> DataFrame:
    return search.unknown_records(records(t).select("record"), t.part.where("p_partkey <= 10").select(F.col("p_brand").alias("gene")).distinct(), "record", "gene")


@query("e20_exact_sites", f"""
WITH q AS (SELECT DISTINCT least(k, {rc_sql('k')}) AS site FROM (SELECT substr({bases_sql('s_suppkey')}, 5, 6) AS k FROM supplier)),
r AS (SELECT record, i, least(k, {rc_sql('k')}) AS site FROM (SELECT record, i, substr(r, CAST(i AS INT), 6) AS k FROM {_R}, generate_series(1, 27) x(i)))
SELECT site, count(record) AS n_sites FROM q LEFT JOIN r USING (site) GROUP BY site""")
def e20(t: Tables) -> DataFrame:
    return search.exact_sites(t.supplier.select(F.substring(digest_bases("s_suppkey"), 5, 6).alias("k")), records(t), "k", "record", "r")


# --- filters, order and greedy selection


@query("h1_h2_h3_conditions", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30.5 AND l_discount <= 0.05 AND l_tax > 0.01")
def h1(t: Tables) -> DataFrame:
    filters = {"a": {"condition": "l_quantity >= 10 & l_quantity < 30.5 & absent <= 1"}, "b": {"condition": ["l_discount <= 0.05", "l_tax > 0.01"]}}
    return selection.filter_table(t.lineitem, filters).select("l_orderkey", long("l_linenumber", "ln"))


@query("h4_pattern_exclusion", f"SELECT p_partkey FROM {PARTS} WHERE NOT regexp_matches(seq, 'GGG|CCC') AND NOT regexp_matches(seq, '^a.*t$', 'i')")
def h4(t: Tables) -> DataFrame:
    return selection.filter_table(parts(t), {"p": {"type": "sequence_pattern", "target": "seq", "patterns": ["ggg|ccc", "^a.*t$"]}}).select("p_partkey")


@query("h6_filters_alone", "SELECT 'a' AS filter, count(*) AS passed FROM lineitem WHERE l_quantity >= 10 UNION ALL SELECT 'b', count(*) FROM lineitem WHERE l_discount <= 0.05 AND l_tax > 0.01")
def h6(t: Tables) -> DataFrame:
    return selection.passes_alone(t.lineitem, {"a": {"condition": "l_quantity >= 10"}, "b": {"condition": "l_discount <= 0.05 & l_tax > 0.01"}})


@query("g1_g2_remove_overlap", f"""
WITH RECURSIVE d AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, s, e, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, l_orderkey * 10 + l_linenumber) AS rn FROM {_DAYS}),
r AS (SELECT l_suppkey, id, rn, e AS last, true AS keep FROM d WHERE rn = 1
  UNION ALL SELECT d.l_suppkey, d.id, d.rn, CASE WHEN d.s > r.last + 2 THEN d.e ELSE r.last END, d.s > r.last + 2 FROM r JOIN d ON d.l_suppkey = r.l_suppkey AND d.rn = r.rn + 1)
SELECT CAST(id AS BIGINT) AS id FROM r WHERE keep""")
def g1(t: Tables) -> DataFrame:
    return selection.remove_overlap(days(t), ["l_suppkey"], "s", "e", 2).select(F.col("row_id").alias("id"))


@query("g3_transcript_merge", f"SELECT l_suppkey, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR)) AS names FROM {_DAYS} GROUP BY ALL")
def g3(t: Tables) -> DataFrame:
    m = A.merge_segments(days(t).withColumn("name", F.col("l_orderkey").cast("string")), ["l_suppkey", "s", "e"], "name")
    return m.select("l_suppkey", "s", "e", F.array_join("transcript_names", ",").alias("names"))


@query("g4_multi_site_oligos")
def g4(t: Tables) -> DataFrame:
    """Checked against brute force in the tests."""
    return selection.remove_overlap_sites(days(t), ["l_suppkey"], "s", "e", ["l_partkey"], 1).select("l_suppkey", "row_id")


@query("g5_site_report", f"SELECT l_suppkey, l_orderkey, count(*) AS n_sites, string_agg(s || '-' || e, ';' ORDER BY s, e) AS oligo_sites FROM (SELECT DISTINCT l_suppkey, l_orderkey, s, e FROM {_DAYS}) GROUP BY ALL HAVING count(*) > 1")
def g5(t: Tables) -> DataFrame:
    return selection.site_report(days(t), ["l_suppkey"], "s", "e", ["l_orderkey"])


@query("g6_avoid_peaks")
def g6(t: Tables) -> DataFrame:
    """Checked against brute force in the tests."""
    sites_ = F.array(F.struct(F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("name"), F.col("s").alias("start"), (F.col("e") + 1).alias("end")), F.struct(F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("name"), (F.col("s") + 500).alias("start"), (F.col("s") + 520).alias("end")))
    rows = days(t).select(F.col("l_suppkey").alias("target"), "row_id", sites_.alias("sites"))
    regions = t.supplier.select(F.col("s_suppkey").alias("target"), F.concat(F.lit("c"), F.col("s_suppkey") % 3).alias("name"), F.lit(100).cast("long").alias("start"), F.lit(1500).cast("long").alias("end"))
    return selection.avoid_peaks(rows, "target", regions, 0.02, (-100, 100))


@query("g8_off_target_pool")
def g8(t: Tables) -> DataFrame:
    """Checked against brute force in the tests."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.max("l_suppkey").alias("m"), F.collect_set("l_suppkey").alias("genes"), F.sum("l_quantity").alias("score"))
    rows = rows.select((F.col("m") % 20).alias("target"), "genes", "score", F.col("l_orderkey").alias("row_id"))
    return selection.off_target_pool(rows, "target", "genes", 3, ["score"]).select("target", "row_id")


@query("g9_w3_i1_rank_order", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_discount DESC, l_orderkey * 10 + l_linenumber) AS rk FROM lineitem")
def g9(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.lineitem.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    order = selection.rank_order(rows, ["l_quantity", "absent"], ["l_discount", "l_quantity"])
    return rows.select("l_orderkey", long("l_linenumber", "ln"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("long").alias("rk"))


@query("g10_g11_w5_even_spacing", f"""
WITH d AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, l_orderkey * 10 + l_linenumber) - 1 AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n, CASE l_suppkey WHEN 1 THEN 1 WHEN 2 THEN 1000000 ELSE 7 END AS w FROM {_DAYS})
SELECT CAST(id AS BIGINT) AS id FROM d WHERE n <= w OR (w = 1 AND rn = 0) OR (w > 1 AND (rn = n - 1 OR rn IN (SELECT CAST(floor(i * ((n - 1) / nullif(CAST(w - 1 AS DOUBLE), 0))) AS BIGINT) FROM generate_series(0, 5) x(i))))""")
def g10(t: Tables) -> DataFrame:
    d = days(t)
    return selection.even_ranks(d, "l_suppkey", "s", selection.quota(d, "l_suppkey", {1: 1, 2: 1_000_000}, 7)).select(F.col("row_id").alias("id"))


@query("g12_w4_collapse_identical", f"SELECT CAST(arg_min(l_orderkey * 10 + l_linenumber, s * CAST(100000000000 AS BIGINT) + l_orderkey * 10 + l_linenumber) AS BIGINT) AS id FROM {_DAYS} GROUP BY l_suppkey, l_partkey")
def g12(t: Tables) -> DataFrame:
    return selection.collapse_identical(days(t), ["l_suppkey"], ["l_partkey"], "s").select(F.col("row_id").alias("id"))


@query("g13_u7_position_along_target", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS BIGINT) AS pos FROM lineitem")
def g13(t: Tables) -> DataFrame:
    a, _ = S.region_bounds(F.concat_ws("_", "l_suppkey", F.col("l_suppkey") + 40))
    return t.lineitem.select("l_orderkey", long("l_linenumber", "ln"), F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")), a).alias("pos"))


# --- summaries

_STAT = "count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x) - min(x), 6) AS range"


def _rounded(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return df.select(*keys, "count", six("mean", "mean"), six("std", "std"), "min", "max", six("median", "median"), six("q25", "q25"), six("q75", "q75"), six("range", "range"))


@query("j1_j6_column_stats", f"SELECT {_STAT} FROM (SELECT l_extendedprice AS x FROM lineitem)")
def j1(t: Tables) -> DataFrame:
    return _rounded(summary.column_stats(t.lineitem, "l_extendedprice"))


@query("j2_grouped_stats", f"SELECT c_mktsegment, {_STAT} FROM (SELECT c_mktsegment, c_acctbal AS x FROM customer) GROUP BY c_mktsegment")
def j2(t: Tables) -> DataFrame:
    return _rounded(summary.column_stats(t.customer, "c_acctbal", ["c_mktsegment"]), ["c_mktsegment"])


_LAST = ("l_quantity", "l_extendedprice", "l_discount")


@query("j6_attribute_stats", " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS attribute, count({c}) AS count, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem GROUP BY l_returnflag" for c in _LAST))
def j6(t: Tables) -> DataFrame:
    return summary.attribute_stats(t.lineitem, list(_LAST), ["l_returnflag"])


@query("j3_overview", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS groups, max(n) AS most, min(n) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def j3(t: Tables) -> DataFrame:
    return summary.overview(t.orders, "o_custkey")


def _staged(t: Tables) -> DataFrame:
    return summary.stage_of(t.lineitem, [("quantity", F.col("l_quantity") >= 10), ("discount", F.col("l_discount") <= 0.05), ("tax", F.col("l_tax") > 0.01)])


_FUNNEL = "(SELECT l_returnflag, count(*) AS b0, count(*) FILTER (WHERE l_quantity >= 10) AS b1, count(*) FILTER (WHERE l_quantity >= 10 AND l_discount <= 0.05) AS b2, count(*) FILTER (WHERE l_quantity >= 10 AND l_discount <= 0.05 AND l_tax > 0.01) AS b3 FROM lineitem GROUP BY l_returnflag)"


@query("j4_w13_stage_funnel", f"SELECT l_returnflag, 'quantity' AS stage, b0 AS before, b1 AS after, b0 - b1 AS removed FROM {_FUNNEL} UNION ALL SELECT l_returnflag, 'discount', b1, b2, b1 - b2 FROM {_FUNNEL} UNION ALL SELECT l_returnflag, 'tax', b2, b3, b2 - b3 FROM {_FUNNEL}")
def j4(t: Tables) -> DataFrame:
    return summary.funnel(_staged(t), ["quantity", "discount", "tax"], ["l_returnflag"])


@query("j5_v9_run_summary", f"SELECT l_returnflag, b0 AS candidates, b3 AS final, CASE WHEN b0 - b1 >= b1 - b2 AND b0 - b1 >= b2 - b3 THEN 'quantity' WHEN b1 - b2 >= b2 - b3 THEN 'discount' ELSE 'tax' END AS top_removal, 'ok' AS status FROM {_FUNNEL}")
def j5(t: Tables) -> DataFrame:
    return summary.run_summary(_staged(t), ["quantity", "discount", "tax"], "l_returnflag")


@query("j7_off_target_summary", "SELECT count(DISTINCT l_suppkey) AS genes, count(DISTINCT CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN l_suppkey END) AS low FROM lineitem")
def j7(t: Tables) -> DataFrame:
    hit = t.lineitem.select("l_suppkey").distinct()
    low = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey")).withColumn("low", F.lit(1))
    return hit.join(low, "l_suppkey", "left").agg(F.count("*").alias("genes"), F.count("low").alias("low"))


@query("j8_histogram", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 12)), 1), 12) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def j8(t: Tables) -> DataFrame:
    return summary.histogram(t.orders, "o_totalprice").select(long("bin", "bin"), "n")


@query("j9_i2_value_counts", "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def j9(t: Tables) -> DataFrame:
    return summary.value_counts(t.lineitem, "l_suppkey", 20)


@query("j10_quantiles", " UNION ALL ".join(f"SELECT {p}e0 AS point, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem" for p in (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)))
def j10(t: Tables) -> DataFrame:
    return summary.quantiles(t.lineitem, "l_extendedprice").select("point", six("value", "value"))


@query("j12_w11_result_check", f"""
WITH d AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, s, e, l_orderkey FROM {_DAYS}), g AS (SELECT *, s - lag(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, id) - 1 AS gap FROM d)
SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS distinct_oligos, CAST(min(gap) AS BIGINT) AS min_gap, CAST(max(e) - min(s) + 1 AS BIGINT) AS span, count(*) FILTER (WHERE s NOT BETWEEN 100 AND 2000) AS s_outside FROM g GROUP BY l_suppkey""")
def j12(t: Tables) -> DataFrame:
    return summary.result_check(days(t), "l_suppkey", "s", "e", "l_orderkey", {"s": (100, 2000)}, tasks_for(t.lineitem))


@query("j13_bin_funnel", "SELECT CAST(l_suppkey % 10 AS BIGINT) AS bin, count(*) AS candidate, count(*) FILTER (WHERE l_quantity > 5) AS filtered, count(*) FILTER (WHERE l_quantity > 5 AND l_returnflag = 'N') AS kept FROM lineitem GROUP BY 1")
def j13(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("bin")).agg(F.count("*").alias("candidate"), F.count_if(F.col("l_quantity") > 5).alias("filtered"), F.count_if((F.col("l_quantity") > 5) & (F.col("l_returnflag") == "N")).alias("kept"))


# --- the evaluator

_BARE = "CASE WHEN NOT regexp_matches(u, '/[ACGT]+/') AND regexp_matches(regexp_replace(u, '/[^/]+/', '', 'g'), '^[ACGT]+$') THEN regexp_replace(u, '/[^/]+/', '', 'g') END"
_RAW = f"(SELECT p_partkey, p_brand, 'R' || p_size % 2 AS role, CASE WHEN p_partkey % 11 = 0 THEN 'N' WHEN p_partkey % 13 = 0 THEN '/ACGT/' ELSE '/5Phos/' END || ' ' || substr({bases_sql('p_partkey % 700')}, 1, 12) AS raw FROM part)"
_REF = f"(SELECT p_partkey, lower(p_brand) AS gene_key, lower(role) AS role_key, dna, CASE WHEN dna IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY lower(p_brand), lower(role), dna ORDER BY p_partkey) > 1 THEN 'duplicate' END AS reason FROM (SELECT *, {_BARE} AS dna FROM (SELECT *, upper(regexp_replace(raw, '\\s+', '', 'g')) AS u FROM {_RAW})))"
_GEN = f"(SELECT p_partkey, p_partkey // 3 AS gset, lower(p_brand) AS gene_key, 'r' || p_size % 2 AS role_key, substr({bases_sql('p_partkey % 650')}, 1, 12) AS dna FROM part WHERE p_partkey % 4 <> 0)"


def reference(t: Tables) -> DataFrame:
    raw = F.concat(F.when(F.col("p_partkey") % 11 == 0, "N").when(F.col("p_partkey") % 13 == 0, "/ACGT/").otherwise("/5Phos/"), F.lit(" "), F.substring(digest_bases(F.col("p_partkey") % 700), 1, 12))
    rows = t.part.select("p_partkey", "p_brand", F.concat(F.lit("R"), F.col("p_size") % 2).alias("role"), raw.alias("raw"))
    return recovery.canonical_rows(rows, "p_brand", "role", "raw", "p_partkey")


def generated(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 4 <> 0").select("p_partkey", F.floor(F.col("p_partkey") / 3).alias("gset"), F.lower("p_brand").alias("gene_key"), F.concat(F.lit("r"), F.col("p_size") % 2).alias("role_key"), F.substring(digest_bases(F.col("p_partkey") % 650), 1, 12).alias("dna"))


def kept(t: Tables) -> DataFrame:
    return reference(t).where("reason is null")


@query("k1_k2_k3_canonical_rows", f"SELECT p_partkey, gene_key, role_key, dna, reason FROM {_REF}")
def k1(t: Tables) -> DataFrame:
    return reference(t).select("p_partkey", "gene_key", "role_key", "dna", "reason")


@query("k4_matches", f"SELECT r.p_partkey, g.n IS NOT NULL AS matched, coalesce(g.n, 0) AS n_generated, g.ids AS generated_ids FROM {_REF} r LEFT JOIN (SELECT gene_key, role_key, dna, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ';' ORDER BY CAST(p_partkey AS VARCHAR)) AS ids FROM {_GEN} GROUP BY ALL) g USING (gene_key, role_key, dna) WHERE reason IS NULL")
def k4(t: Tables) -> DataFrame:
    return recovery.matches(kept(t), generated(t), "p_partkey").select("p_partkey", "matched", "n_generated", "generated_ids")


@query("k5_set_recovery", f"""
WITH r AS (SELECT *, p_partkey // 2 AS rset FROM {_REF} WHERE reason IS NULL), need AS (SELECT rset, count(DISTINCT role_key || dna) AS n FROM r GROUP BY 1),
have AS (SELECT rset, gset, count(DISTINCT role_key || r.dna) AS h FROM r JOIN {_GEN} g USING (gene_key, role_key, dna) GROUP BY 1, 2)
SELECT rset, coalesce(max(h), 0) = any_value(n) AS matched FROM need LEFT JOIN have USING (rset) GROUP BY rset""")
def k5(t: Tables) -> DataFrame:
    return recovery.set_recovery(kept(t).withColumn("rset", F.floor(F.col("p_partkey") / 2)), generated(t), "rset", "gset")


@query("k6_wide_long_consistency", "SELECT l_partkey, l_returnflag, 'wide' AS only_in FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F') UNION ALL SELECT l_partkey, l_returnflag, 'long' FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F' EXCEPT SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O')")
def k6(t: Tables) -> DataFrame:
    return recovery.same_pairs(t.lineitem.where("l_linestatus = 'O'"), t.lineitem.where("l_linestatus = 'F'"), ["l_partkey", "l_returnflag"])


@query("k7_j11_recovery_rates", f"""
WITH m AS (SELECT r.gene_key, r.role_key, g.n IS NOT NULL AS ok FROM {_REF} r LEFT JOIN (SELECT gene_key, role_key, dna, count(*) AS n FROM {_GEN} GROUP BY ALL) g USING (gene_key, role_key, dna) WHERE reason IS NULL),
a AS (SELECT role_key, gene_key, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM m GROUP BY ALL UNION ALL SELECT 'all', gene_key, count(*), count(*) FILTER (WHERE ok) FROM m GROUP BY gene_key)
SELECT role_key, CAST(sum(n) AS BIGINT) AS refs, CAST(sum(k) AS BIGINT) AS matched, round(100.0e0 * sum(k) / sum(n), 6) AS srr, round(100e0 * avg(CAST(k > 0 AS INT)), 6) AS trr, round(100e0 * avg(k / CAST(n AS DOUBLE)), 6) AS mtr FROM a GROUP BY role_key""")
def k7(t: Tables) -> DataFrame:
    r = recovery.rates(recovery.matches(kept(t), generated(t), "p_partkey"))
    return r.select("role_key", F.col("references").alias("refs"), "matched", six("srr", "srr"), six("trr", "trr"), six("mtr", "mtr"))


@query("k8_miss_reasons", f"""
WITH g AS (SELECT * FROM {_GEN} WHERE gene_key <> 'brand#11'), x AS (SELECT * FROM {_REF} r WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.gene_key = r.gene_key AND g.role_key = r.role_key AND g.dna = r.dna))
SELECT CASE WHEN gene_key NOT IN (SELECT gene_key FROM g) THEN 'gene_absent' WHEN (gene_key, role_key) NOT IN (SELECT gene_key, role_key FROM g) THEN 'role_absent' WHEN length(dna) <> 12 THEN 'length_differs' ELSE 'sequence_differs' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def k8(t: Tables) -> DataFrame:
    return recovery.misses(kept(t), generated(t).where("gene_key <> 'brand#11'"))


@query("k9_l9_stage_union", f"SELECT 'all' AS stage, role_key, count(*) AS n FROM {_REF} GROUP BY ALL UNION ALL SELECT 'kept', role_key, count(*) FROM {_REF} WHERE reason IS NULL GROUP BY ALL")
def k9(t: Tables) -> DataFrame:
    count = lambda df, stage: df.groupBy("role_key").agg(F.count("*").alias("n")).withColumn("stage", F.lit(stage))
    return count(reference(t), "all").unionByName(count(kept(t), "kept"), allowMissingColumns=True)


@query("k10_first_with_sites", f"SELECT dna, CAST(min(p_partkey) AS BIGINT) AS first, CAST(count(DISTINCT gene_key) AS BIGINT) AS sites FROM {_GEN} GROUP BY dna")
def k10(t: Tables) -> DataFrame:
    out = recovery.first_with_sites(generated(t), "dna", "p_partkey", ["gene_key"])
    return out.select("dna", F.col("p_partkey").alias("first"), F.json_array_length("sites").cast("long").alias("sites"))


@query("k11_lost_reasons", "SELECT CASE WHEN l_quantity < 10 THEN 'low' ELSE 'other' END AS reason, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def k11(t: Tables) -> DataFrame:
    after = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return recovery.lost(t.lineitem, after, "l_orderkey", F.when(F.col("l_quantity") < 10, "low").otherwise("other"))


# --- set operators


@query("l10_ordered_distinct", "SELECT l_suppkey, min(l_orderkey) AS first FROM lineitem GROUP BY l_suppkey")
def l10(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first"))


@query("l11_intersect_difference", "SELECT 'both' AS k, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') UNION ALL SELECT 'left', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F')")
def l11(t: Tables) -> DataFrame:
    a, b = t.lineitem.where("l_linestatus = 'O'").select("l_partkey"), t.lineitem.where("l_linestatus = 'F'").select("l_partkey")
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
    return n(a.intersect(b), "both").unionAll(n(a.subtract(b), "left"))


@query("l8_closest_names", "SELECT n_name, arg_min(r_name, levenshtein(n_name, r_name) * 1000 + r_regionkey) AS near FROM nation, region GROUP BY n_name")
def l8(t: Tables) -> DataFrame:
    """Names and the closest of a few known ones, by edit distance."""
    both = t.nation.select("n_name").crossJoin(F.broadcast(t.region))
    return both.groupBy("n_name").agg(F.min_by("r_name", F.levenshtein("n_name", "r_name") * 1000 + F.col("r_regionkey")).alias("near"))


@query("w2_position_numbering", f"SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, l_orderkey * 10 + l_linenumber) - 1 AS probe_index FROM {_DAYS}")
def w2(t: Tables) -> DataFrame:
    return W.number_within(days(t), ["l_suppkey"], ["s", "row_id"], "probe_index").select(F.col("row_id").alias("id"), "probe_index")


@query("w11_event_gaps", "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events")
def event_gaps(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")).alias("gap"))


# --- protocols

PROTOCOL = {
    "targets": ["all"],
    "extracts": {"target_region": {"length": 20, "step": 1}},
    "probes": {"probe": {"template": "{arm}TT{tail}", "parts": {"arm": {"expr": "rc(target_region[0:12])"}, "tail": {"expr": "target_region[12:]"}}}},
    "attributes": {"gc": {"target": "target_region", "type": "gc_content"}},
    "post_process": {"filters": {"gc": {"condition": "gc >= 0.4 & gc <= 0.6"}}, "remove_overlap": {"location_interval": 2}, "sorts": {"is_ascending": ["gc"]}},
}


@query("protocol_design", f"""
WITH RECURSIVE w AS (SELECT p_partkey, CAST(s + 1 AS BIGINT) AS st, substr(seq, CAST(s AS INT) + 1, 20) AS tr FROM {PARTS}, generate_series(0, 12) a(s)),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY st) AS rn FROM w WHERE (20 - length(replace(replace(tr, 'G', ''), 'C', ''))) / 20e0 BETWEEN 0.4 AND 0.6),
r AS (SELECT p_partkey, st, tr, rn, st + 19 AS last, true AS keep FROM f WHERE rn = 1 UNION ALL SELECT f.p_partkey, f.st, f.tr, f.rn, CASE WHEN f.st > r.last + 2 THEN f.st + 19 ELSE r.last END, f.st > r.last + 2 FROM r JOIN f ON f.p_partkey = r.p_partkey AND f.rn = r.rn + 1)
SELECT CAST(p_partkey AS VARCHAR) AS target, st AS start, {rc_sql('substr(tr, 1, 12)')} || 'TT' || substr(tr, 13) AS probe, round((20 - length(replace(replace(tr, 'G', ''), 'C', ''))) / 20e0, 6) AS gc FROM r WHERE keep""")
def protocol_design(t: Tables) -> DataFrame:
    from ..plans import protocol

    out = protocol.run(PROTOCOL, dealt_parts(t).select(F.col("p_partkey").cast("string").alias("target"), "seq"))
    return out.select("target", "start", "probe", six("gc", "gc"))


#: A design that searches the records for other genes: 18 bases of a part, no other part within one substitution.
SEARCHING = {
    "targets": ["all"],
    "extracts": {"target_region": {"length": 18, "step": 7}},
    "probes": {"probe": {"expr": "rc(target_region)"}},
    "attributes": {"gc": {"target": "target_region", "type": "gc_content"}, "hits": {"target": "target_region", "type": "mapped_genes", "max_mismatches": 1, "strand": "sense"}},
    "post_process": {"filters": {"hits": {"condition": "hits <= 1"}, "gc": {"condition": "gc >= 0.3 & gc <= 0.7"}}, "sorts": {"is_ascending": ["start"]}},
}


@query("protocol_off_targets", f"""
WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS target, CAST(s + 1 AS BIGINT) AS start, substr(seq, CAST(s AS INT) + 1, 18) AS tr FROM {PARTS}, (VALUES (0), (7), (14)) a(s)),
r AS (SELECT CAST(l_orderkey AS VARCHAR) AS g, r FROM (SELECT l_orderkey, l_linenumber, substr(seq, 1, 24) AS r FROM (SELECT l_orderkey, l_linenumber, translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM lineitem WHERE l_linenumber = 1))),
h AS (SELECT DISTINCT w.target, w.start, r.g FROM (SELECT * FROM w WHERE (18 - length(replace(replace(tr, 'G', ''), 'C', ''))) / 18e0 BETWEEN 0.3 AND 0.7) w, r, (VALUES (0), (1), (2), (3), (4), (5), (6)) x(i) WHERE hamming(tr, substr(r.r, i + 1, 18)) <= 1)
SELECT w.target, w.start, CAST(count(h.g) AS BIGINT) AS hits FROM w LEFT JOIN h USING (target, start)
WHERE (18 - length(replace(replace(w.tr, 'G', ''), 'C', ''))) / 18e0 BETWEEN 0.3 AND 0.7 GROUP BY w.target, w.start HAVING count(h.g) <= 1""")
def protocol_off_targets(t: Tables) -> DataFrame:
    from ..plans import protocol

    records_ = t.lineitem.where("l_linenumber = 1").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_t")).alias("record"), F.substring(digest_bases("l_partkey"), 1, 24).alias("seq"))
    out = protocol.run(SEARCHING, dealt_parts(t).select(F.col("p_partkey").cast("string").alias("target"), "seq"), {"records": records_})
    return out.select("target", "start", "hits")


#: The design above with a last base that turns with the probe's number along its target.
NUMBERED = PROTOCOL | {"probes": {"probe": {"template": "{core}{turn}", "parts": {"core": {"expr": "rc(target_region[0:12])"}, "turn": {"expr": "'ACGT'[probe_index % 4]"}}}}}


@query("d8_d10_final_numbers", f"""
WITH RECURSIVE w AS (SELECT p_partkey, CAST(s + 1 AS BIGINT) AS st, substr(seq, CAST(s AS INT) + 1, 20) AS tr FROM {PARTS}, generate_series(0, 12) a(s)),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY st) AS rn FROM w WHERE (20 - length(replace(replace(tr, 'G', ''), 'C', ''))) / 20e0 BETWEEN 0.4 AND 0.6),
r AS (SELECT p_partkey, st, tr, rn, st + 19 AS last, true AS keep FROM f WHERE rn = 1 UNION ALL SELECT f.p_partkey, f.st, f.tr, f.rn, CASE WHEN f.st > r.last + 2 THEN f.st + 19 ELSE r.last END, f.st > r.last + 2 FROM r JOIN f ON f.p_partkey = r.p_partkey AND f.rn = r.rn + 1)
SELECT CAST(p_partkey AS VARCHAR) AS target, st AS start, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY st) - 1 AS BIGINT) AS probe_index, {rc_sql('substr(tr, 1, 12)')} || substr('ACGT', CAST((row_number() OVER (PARTITION BY p_partkey ORDER BY st) - 1) % 4 AS INT) + 1, 1) AS probe FROM r WHERE keep""")
def final_numbers(t: Tables) -> DataFrame:
    from ..plans import protocol

    out = protocol.run(NUMBERED, dealt_parts(t).select(F.col("p_partkey").cast("string").alias("target"), "seq"))
    return out.select("target", "start", long("probe_index", "probe_index"), "probe")


@query("d12_modifications", f"SELECT p_partkey, substr(seq, 1, 20) AS probe, '5prime:phosphate;3prime:fluorophore Cy5;internal:disulfide 7' AS chemistry FROM {PARTS}")
def d12(t: Tables) -> DataFrame:
    from ..plans import finishing

    probes = {"probe": {"expr": "target_region", "modifications": {"5prime": "phosphate", "3prime": {"type": "fluorophore", "name": "Cy5"}, "internal": [{"type": "disulfide", "after_base": 7}]}}}
    out = finishing.annotate(parts(t).select("p_partkey", F.substring("seq", 1, 20).alias("probe")), probes)
    item = lambda x: F.concat(x["position"], F.lit(":"), F.concat_ws(" ", x["type"], x["name"], x["after_base"].cast("string")))
    return out.select("p_partkey", "probe", F.array_join(F.transform("probe__modifications", item), ";").alias("chemistry"))


@query("u9_written_lists", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '; ' || p_partkey WHEN 1 THEN p_type || '; ' || p_brand WHEN 2 THEN p_name ELSE '' END AS names FROM part")
def u9(t: Tables) -> DataFrame:
    from ..plans import finishing

    quoted = F.format_string("['%s', %d]", "p_brand", "p_partkey")
    pair = F.format_string("(\"%s\", '%s')", "p_type", "p_brand")
    text = F.when(F.col("p_partkey") % 4 == 0, quoted).when(F.col("p_partkey") % 4 == 1, pair).when(F.col("p_partkey") % 4 == 2, F.col("p_name"))
    return t.part.select("p_partkey", finishing.list_text(text).alias("names"))


@query("u16_file_stems", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'probes' ELSE regexp_replace(regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9_.-]', '_', 'g'), '^\\.+', '') END AS stem FROM part")
def u16(t: Tables) -> DataFrame:
    from ..plans import finishing

    raw = F.when(F.col("p_partkey") % 3 == 0, "...").otherwise(F.concat(F.lit(".."), "p_type", F.lit("/"), "p_brand"))
    return t.part.select("p_partkey", finishing.file_stem_column(raw).alias("stem"))


@query("g14_ordered_overlap", """
WITH RECURSIVE f AS (SELECT l_partkey AS g, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS ln, l_orderkey % 300 AS s, l_orderkey % 300 + CAST(l_quantity AS BIGINT) AS e,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey % 300, CAST(l_quantity AS BIGINT), l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem),
r AS (SELECT *, e AS last, true AS keep FROM f WHERE rn = 1 UNION ALL SELECT f.*, CASE WHEN f.s > r.last THEN f.e ELSE r.last END, f.s > r.last FROM r JOIN f ON f.g = r.g AND f.rn = r.rn + 1)
SELECT g, o, ln, s, e FROM r WHERE keep""")
def g14(t: Tables) -> DataFrame:
    s = F.col("l_orderkey") % 300
    d = t.lineitem.select(F.col("l_partkey").alias("g"), F.col("l_orderkey").alias("o"), long("l_linenumber", "ln"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"), "l_extendedprice")
    return selection.ordered_overlap(d, ["g"], "s", "e", ["e", F.desc("l_extendedprice"), "o", "ln"]).select("g", "o", "ln", "s", "e")


@query("i3_examples", "SELECT p_partkey, p_name, round(CAST(p_retailprice AS DOUBLE), 6) AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def i3(t: Tables) -> DataFrame:
    return summary.examples(t.part, [F.desc("p_retailprice"), "p_partkey"], 20).select("p_partkey", "p_name", six("p_retailprice", "price"))


@query("c2_listed_transcripts", "SELECT p_brand AS gene, 'P' || p_partkey || '.' || (p_partkey % 3) AS transcript FROM part WHERE p_partkey % 7 = 0 OR (p_partkey % 7 = 1 AND p_partkey % 3 = 2)")
def c2_listed(t: Tables) -> DataFrame:
    name = F.concat(F.lit("P"), F.col("p_partkey"), F.lit("."), F.col("p_partkey") % 3)
    known = t.part.select(F.col("p_brand").alias("gene"), name.alias("transcript"))
    bare = t.part.where("p_partkey % 7 = 0").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("wanted"))
    exact = t.part.where("p_partkey % 7 = 1 and p_partkey % 3 = 2").select(name.alias("wanted"))
    return A.listed_transcripts(known, bare.unionAll(exact), "gene", "transcript")


@query("c2_targets_without_transcript", "SELECT 'g' || p_partkey // 4 AS gene, 'no transcript of target g' || p_partkey // 4 AS problem FROM part GROUP BY p_partkey // 4 HAVING count(*) FILTER (WHERE p_size < 10) = 0")
def c2_without(t: Tables) -> DataFrame:
    tags = F.when(F.col("p_size") < 10, F.array(F.lit("Ensembl_canonical"))).otherwise(F.array(F.lit("basic")))
    d = t.part.select(F.concat(F.lit("g"), F.floor(F.col("p_partkey") / 4)).alias("gene"), F.col("p_partkey").alias("transcript"), tags.alias("tags"))
    return A.without_transcript(d, A.choose_transcript(d, "gene", "transcript", "tags", "canonical"), "gene")
