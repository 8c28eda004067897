"""Generators, projections and scalar attributes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import barcodes, folding, thermo
from ..functions import sequence as S
from ..operators import windows as W
from ..plans.expression import Typed, compile_expression
from .base import PARTS, Tables, dealt_parts, long, parts, query, rc_sql, six


@query("b1_sliding_windows", f"""
SELECT p_partkey, CAST(s AS BIGINT) AS start0, CAST(k AS BIGINT) AS size, substr(seq, CAST(s AS INT) + 1, CAST(k AS INT)) AS win
FROM {PARTS}, generate_series(0, 12, 2) a(s), generate_series(20, 22) b(k) WHERE s + k <= length(seq)""")
def b1(t: Tables) -> DataFrame:
    return W.sliding_windows(parts(t), "seq", 20, 22, 2).select("p_partkey", long("start0", "start0"), long("size", "size"), F.col("window").alias("win"))


@query("b2_segment_windows", f"""
SELECT p_brand || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, s) AS probe_id, p_partkey * 100 + s AS w_start, p_partkey * 100 + s + 29 AS w_end
FROM {PARTS}, generate_series(0, 2) a(s)""")
def b2(t: Tables) -> DataFrame:
    seg = parts(t).withColumn("st", F.col("p_partkey") * 100)
    return W.segment_windows(seg, "p_brand", "seq", "st", 30, by=["p_partkey"]).select("probe_id", long("w_start", "w_start"), long("w_end", "w_end"))


@query("b3_spliced_windows", f"""
WITH seg AS (SELECT p_partkey // 3 AS gene, (p_partkey % 3) * 100 + 1 AS st, p_partkey, seq FROM {PARTS}),
j AS (SELECT gene, string_agg(seq, '' ORDER BY st) AS whole FROM seg GROUP BY gene)
SELECT gene, CAST(s AS BIGINT) AS start0, substr(whole, CAST(s AS INT) + 1, 24) AS win FROM j, generate_series(0, 72, 4) a(s) WHERE s + 24 <= length(whole)""")
def b3(t: Tables) -> DataFrame:
    seg = parts(t).select(F.floor(F.col("p_partkey") / 3).alias("gene"), (F.col("p_partkey") % 3 * 100 + 1).alias("st"), (F.col("p_partkey") % 3 * 100 + 32).alias("en"), F.col("p_partkey").cast("string").alias("name"), "seq")
    return W.spliced_windows(seg, "gene", "st", "en", "seq", "name", 24, 4).select(long("gene", "gene"), long("start0", "start0"), F.col("window").alias("win"))


@query("b3_spliced_coordinates", f"""
WITH seg AS (SELECT p_partkey // 3 AS gene, (p_partkey % 3) * 100 + 1 AS st, p_partkey, 32 * (row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) - 1) AS a FROM part),
n AS (SELECT gene, 32 * count(*) AS n FROM seg GROUP BY gene),
w AS (SELECT gene, s FROM n, generate_series(0, 72, 4) x(s) WHERE s + 24 <= n)
SELECT w.gene, w.s AS start0, min_by(st + w.s - a, a) AS gstart, max_by(st + w.s + 23 - a, a) AS gend, string_agg(CAST(p_partkey AS VARCHAR), ';' ORDER BY a) AS segments
FROM w JOIN seg ON seg.gene = w.gene AND a < w.s + 24 AND a + 32 > w.s GROUP BY w.gene, w.s""")
def b3c(t: Tables) -> DataFrame:
    seg = parts(t).select(F.floor(F.col("p_partkey") / 3).alias("gene"), (F.col("p_partkey") % 3 * 100 + 1).alias("st"), (F.col("p_partkey") % 3 * 100 + 32).alias("en"), F.col("p_partkey").cast("string").alias("name"), "seq")
    return W.spliced_windows(seg, "gene", "st", "en", "seq", "name", 24, 4).select(long("gene", "gene"), long("start0", "start0"), long("start", "gstart"), long("end", "gend"), "segments")


@query("b6_b7_layouts", f"""
WITH l AS (SELECT a, g, b, row_number() OVER (PARTITION BY a + g + b ORDER BY a, g, b) AS layout FROM generate_series(8, 10) x(a), generate_series(1, 2) y(g), generate_series(8, 10) z(b) WHERE a + g + b BETWEEN 19 AND 20),
w AS (SELECT p_partkey, s, k, substr(seq, CAST(s AS INT) + 1, CAST(k AS INT)) AS win FROM {PARTS}, generate_series(0, 12, 6) p(s), generate_series(19, 20) q(k) WHERE s + k <= 32)
SELECT p_partkey, CAST(s AS BIGINT) AS start0, CAST(layout AS BIGINT) AS layout, 'left:' || a || '_gap:' || g || '_right:' || b AS layout_id, substr(win, 1, CAST(a AS INT)) AS left_seq, substr(win, CAST(a + g AS INT) + 1, CAST(b AS INT)) AS right_seq, CAST(a + g + 1 AS BIGINT) AS right_start
FROM w JOIN l ON a + g + b = k""")
def b7(t: Tables) -> DataFrame:
    w = W.sliding_windows(parts(t), "seq", 19, 20, 6)
    out = W.expand_layouts(w, "window", {"left": (8, 10), "gap": (1, 2), "right": (8, 10)}, 19, 20)
    return out.select("p_partkey", long("start0", "start0"), long("layout", "layout"), "layout_id", "left_seq", "right_seq", long("right_start", "right_start"))


@query("b8_encoding_variants", "SELECT n_name, r_name AS variant FROM nation, region")
def b8(t: Tables) -> DataFrame:
    return W.replicate(t.nation.select("n_name"), t.region.select(F.col("r_name").alias("variant")))


@query("b9_kmer_explode", f"SELECT p_brand, substr(seq, CAST(s AS INT), 6) AS kmer, count(*) AS n FROM {PARTS}, generate_series(1, 27) a(s) GROUP BY ALL")
def b9(t: Tables) -> DataFrame:
    return W.kmer_rows(parts(t), "seq", 6).groupBy("p_brand", "kmer").agg(F.count("*").alias("n"))


@query("b13_pattern_prevention", f"SELECT p_partkey, seq FROM {PARTS} WHERE NOT contains(seq, 'GGA') AND NOT contains({rc_sql('seq')}, 'GGA') AND NOT contains(seq, 'ACGT') AND NOT contains({rc_sql('seq')}, 'ACGT')")
def b13(t: Tables) -> DataFrame:
    return parts(t).where(barcodes.free_of(F.col("seq"), ["GGA", "ACGT"])).select("p_partkey", "seq")


@query("b10_barcodes_max_orthogonality")
def b10(t: Tables) -> DataFrame:
    return barcodes.table(t.spark, barcodes.max_orthogonality(40, 16, gc=(30, 70)))


@query("b11_barcodes_max_size")
def b11(t: Tables) -> DataFrame:
    return barcodes.table(t.spark, barcodes.max_size(12, 5, 200))


@query("b12_barcode_preset")
def b12(t: Tables) -> DataFrame:
    return barcodes.table(t.spark, barcodes.preset("pcr", 24))


@query("c9_mask_drop", f"SELECT p_partkey, CAST(s AS BIGINT) AS start0 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr(seq, 1, 10) || lower(substr(seq, 11, 6)) || substr(seq, 17) ELSE seq END AS m FROM {PARTS}), generate_series(0, 22) a(s) WHERE NOT regexp_matches(substr(m, CAST(s AS INT) + 1, 10), '[a-zN]')")
def c9(t: Tables) -> DataFrame:
    low = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("seq", 1, 10), F.lower(F.substring("seq", 11, 6)), F.substring("seq", 17, 16))).otherwise(F.col("seq"))
    return W.unmasked(W.sliding_windows(parts(t).withColumn("m", low), "m", 10), "window").select("p_partkey", long("start0", "start0"))


# --- the expression language

_EXPRESSIONS = {
    "head": ("seq[0:11]", "substr(seq, 1, 11)"),
    "tail": ("seq[-5:]", "substr(seq, -5)"),
    "rc_part": ("rc(seq[3:20])", rc_sql("substr(seq, 4, 17)")),
    "one": ("seq[p_partkey % 7]", "substr(seq, CAST(p_partkey % 7 AS INT) + 1, 1)"),
    "every_third": ("seq[1:20:3]", "substr(seq,2,1)||substr(seq,5,1)||substr(seq,8,1)||substr(seq,11,1)||substr(seq,14,1)||substr(seq,17,1)||substr(seq,20,1)"),
    "backwards": ("seq[::-1]", "reverse(seq)"),
    "joined": ("'AA' + seq[2:4] + 'TT'", "'AA' || substr(seq, 3, 2) || 'TT'"),
    "beyond": ("seq[40:50]", "''"),
    "sum_mod": ("(p_partkey + 3) % 5", "(p_partkey + 3) % 5"),
    "neg_mod": ("-p_partkey % 7", "((-p_partkey) % 7 + 7) % 7"),
}


@query("d1_expressions", f"SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, (_, sql) in _EXPRESSIONS.items())} FROM {PARTS}".replace("(p_partkey + 3) % 5 AS", "CAST((p_partkey + 3) % 5 AS BIGINT) AS"))
def d1(t: Tables) -> DataFrame:
    scope = {"seq": Typed(F.col("seq"), "text"), "p_partkey": Typed(F.col("p_partkey"), "number")}
    return parts(t).select("p_partkey", *[compile_expression(e, scope).column.alias(n) for n, (e, _) in _EXPRESSIONS.items()])


@query("d3_nested_lookup", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'AAC' WHEN 1 THEN 'CCG' END AS bc, CASE n_regionkey WHEN 0 THEN CASE n_nationkey % 2 WHEN 0 THEN 'x' ELSE 'y' END WHEN 1 THEN 'z' END AS item FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_regionkey FROM nation)")
def d3(t: Tables) -> DataFrame:
    enc = {"0": {"BC": "AAC", "L": ["x", "y"]}, "1": {"BC": "CCG", "L": ["z", "z"]}}
    scope = {"target": Typed(F.col("n_regionkey").cast("string"), "text"), "probe_index": Typed(F.col("n_nationkey"), "number")}
    return t.nation.select(long("n_nationkey", "n_nationkey"), compile_expression("encoding[target]['BC']", scope, {"encoding": enc}).column.alias("bc"), compile_expression("encoding[target]['L'][probe_index % 2]", scope, {"encoding": enc}).column.alias("item"))


@query("d4_reverse_complement", f"SELECT p_partkey, {rc_sql('seq')} AS rc, least(seq, {rc_sql('seq')}) AS canon FROM {PARTS}")
def d4(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", S.reverse_complement("seq").alias("rc"), S.canonical("seq").alias("canon"))


@query("d6_template", f"SELECT p_partkey, substr(seq, 1, 8) || 'TT' || {rc_sql('substr(seq, 9, 8)')} AS probe FROM {PARTS}")
def d6(t: Tables) -> DataFrame:
    from ..plans.protocol import template_column

    scope = {"left": Typed(F.substring("seq", 1, 8), "text"), "right": Typed(S.reverse_complement(F.substring("seq", 9, 8)), "text")}
    return parts(t).select("p_partkey", template_column("{left}TT{right}", scope).alias("probe"))


@query("d9_w1_candidate_numbering", f"SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS probe_index FROM {PARTS}")
def d9(t: Tables) -> DataFrame:
    return W.number_within(parts(t), ["p_brand"], ["p_partkey"], "probe_index").select("p_partkey", "p_brand", "probe_index")


@query("d14_transcript_lists", "SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS names FROM documents GROUP BY source")
def d14(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("names"))


# --- attributes


@query("f1_f2_gc_and_length", f"SELECT p_partkey, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(length(seq) AS DOUBLE), 6) AS gc, CAST(length(seq) AS BIGINT) AS len FROM {PARTS}")
def f1(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(S.gc_content("seq"), "gc"), long(F.length("seq"), "len"))


@query("f3_base_fraction", f"SELECT p_partkey, round(len(regexp_extract_all(substr(seq, 3, 10), '[AT]')) / 10.0, 6) AS head, round(len(regexp_extract_all(substr(seq, 28), 'G')) / 5.0, 6) AS tail FROM {PARTS}".replace("/ 10.0", "/ CAST(10 AS DOUBLE)").replace("/ 5.0", "/ CAST(5 AS DOUBLE)"))
def f3(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(S.base_fraction("seq", "AT", (3, 12)), "head"), six(S.base_fraction("seq", "G", (-5, -1)), "tail"))


@query("f4_max_homopolymer", f"SELECT p_partkey, CAST(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))) AS BIGINT) AS run, CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'G+'), lambda x: length(x))), 0) AS BIGINT) AS g_run FROM {PARTS}")
def f4(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", long(S.max_homopolymer("seq"), "run"), long(S.max_homopolymer("seq", "G"), "g_run"))


@query("f5_max_window_count", f"SELECT p_partkey, CAST(max(len(regexp_extract_all(substr(seq, CAST(s AS INT), 6), 'C'))) AS BIGINT) AS most FROM {PARTS}, generate_series(1, 27) a(s) GROUP BY p_partkey")
def f5(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", long(S.max_window_count("seq", "C", 6), "most"))


def _sums(table: dict, i: int) -> str:
    pairs = " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in table.items())
    return f"list_sum(list_transform(generate_series(1, length(seq) - 1), lambda i: CASE substr(seq, CAST(i AS INT), 2) {pairs} END))"


_AT = "(CAST(substr(seq, 1, 1) IN ('A', 'T') AS INT) + CAST(substr(seq, -1) IN ('A', 'T') AS INT))"
_NN = f"(SELECT p_partkey, seq, length(seq) AS n, {_AT} AS tips, {_sums(thermo.SANTALUCIA_1998, 0)} AS h, {_sums(thermo.SANTALUCIA_1998, 1)} AS s, {_sums(thermo.SANTALUCIA_2004, 0)} AS h4, {_sums(thermo.SANTALUCIA_2004, 1)} AS s4, {_sums(thermo.SUGIMOTO_1996, 0)} AS hs, {_sums(thermo.SUGIMOTO_1996, 1)} AS ss FROM {PARTS})"


@query("f6_tm_primer", f"SELECT p_partkey, round((h + tips * 2.3e0 + (2 - tips) * 0.1e0) * 1000 / (s + tips * 4.1e0 - (2 - tips) * 2.8e0 + (n - 1) * {0.368 * math.log(0.05)!r} + 1.987e0 * {math.log(50 / 4e9)!r}) - 273.15e0, 6) AS tm FROM {_NN}")
def f6(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(thermo.tm_primer("seq"), "tm"))


@query("f7_tm_padlock", f"SELECT p_partkey, round((hs + 0.6e0) * 1000 / (ss - 9.0e0 + {1.9872 * math.log(100e-9)!r}) - 273.15e0 + {16.6 * math.log10(0.075 + 3.795 * math.sqrt(0.01))!r} - 14.4e0, 6) AS tm FROM {_NN}")
def f7(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(thermo.tm_padlock("seq", 75, 10, 100, 20), "tm"))


@query("f8_tm_miner", f"SELECT p_partkey, round(round((h + tips * 2.3e0 + (2 - tips) * 0.1e0) * 1000 / (s + tips * 4.1e0 - (2 - tips) * 2.8e0 + (n - 1) * {0.368 * math.log(0.39)!r} + 1.987e0 * {math.log(12.5e-9)!r}) - 273.15e0, 2) - 32.5e0, 6) AS tm FROM {_NN}")
def f8(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(thermo.tm_miner("seq", 390, 25, 50), "tm"))


@query("f9_tm_merfish", f"SELECT p_partkey, round((h4 + tips * 2.2e0 + 0.2e0) * 1000 / (s4 + tips * 6.9e0 - 5.7e0 + (n - 1) * {0.368 * math.log(0.3)!r} + {1.9872 * math.log(5e-9)!r}) - 273.15e0, 6) AS tm FROM {_NN}")
def f9(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(thermo.tm_merfish("seq", 300, 5), "tm"))


@query("f10_rna_dna_37", f"SELECT p_partkey, round({_sums({k: (v,) for k, v in thermo.RNA_DNA_37.items()}, 0)} - {math.log(0.115) * -0.175 - 0.2!r}, 6) AS dg FROM {PARTS}")
def f10(t: Tables) -> DataFrame:
    return parts(t).select("p_partkey", six(thermo.rna_dna_37("seq"), "dg"))


@query("f11_f13_stem_score")
def f11(t: Tables) -> DataFrame:
    """A stand-in for folding energies, under a name of its own."""
    return dealt_parts(t).select("p_partkey", long(thermo.stem_score("seq"), "stem_score"))


@query("f11_fold_score")
def f11_fold(t: Tables) -> DataFrame:
    """Checked against all structures in the tests."""
    return dealt_parts(t).select("p_partkey", folding.fold_score("seq").alias("fold_score"))


@query("f13_blocks")
def f13_blocks(t: Tables) -> DataFrame:
    """Checked against all structures in the tests."""
    return dealt_parts(t).select("p_partkey", folding.blocks("seq", 10).cast("long").alias("blocks"))


@query("f12_self_match", f"SELECT p_partkey, count(*) FILTER (WHERE substr(seq, CAST(i AS INT) + 1, 4) = substr({rc_sql('seq')}, CAST(j AS INT) + 1, 4) AND i + j + 2 <> length(seq)) AS n FROM {PARTS}, generate_series(0, 28) a(i), generate_series(0, 28) b(j) GROUP BY p_partkey")
def f12(t: Tables) -> DataFrame:
    return dealt_parts(t).select("p_partkey", long(S.self_match("seq"), "n"))


@query("f14_f15_differences", f"""
WITH a AS (SELECT p_partkey, (length(x) - length(replace(replace(x, 'G', ''), 'C', ''))) / CAST(16 AS DOUBLE) AS g1, (length(y) - length(replace(replace(y, 'G', ''), 'C', ''))) / CAST(16 AS DOUBLE) AS g2 FROM (SELECT p_partkey, substr(seq, 1, 16) AS x, substr(seq, 17) AS y FROM {PARTS}))
SELECT p_partkey, round(abs(g1 - g2), 6) AS diff, round(greatest(g1, g2) - least(g1, g2), 6) AS spread FROM a""")
def f14(t: Tables) -> DataFrame:
    a, b = S.gc_content(F.substring("seq", 1, 16)), S.gc_content(F.substring("seq", 17, 16))
    return parts(t).select("p_partkey", six(F.abs(a - b), "diff"), six(thermo.tm_difference([a, b], ["gc", "gc"]), "spread"))


# --- utility functions


@query("u1_a1_a2_annotation_attributes", """
SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS chr, CASE WHEN s_suppkey % 7 = 0 THEN CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END ELSE 'G' || s_suppkey || '.1' END AS gene_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS gene_name, CAST(51 AS BIGINT) AS length FROM supplier""")
def u1(t: Tables) -> DataFrame:
    from ..sources.readers import parse_gtf

    info = F.concat(F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit('gene_id "G'), F.col("s_suppkey"), F.lit('.1"; '))).otherwise(""), F.lit('gene_name "'), F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_name")), F.lit('"; transcript_id "T";'))
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("chr"), F.col("s_nationkey")).alias("chr"), F.lit("exon").alias("type"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 50).alias("end"), info.alias("info"))
    return parse_gtf(rows).select("s_suppkey", "chr", "gene_id", "gene_name", long("length", "length"))


@query("u2_u3_version_strip", "SELECT p_partkey, 'ENSG' || p_partkey AS a, 'X' || p_partkey || '.3' AS b FROM part")
def u2(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.strip_version(F.concat(F.lit("ENSG"), F.col("p_partkey"), F.lit(".12"))).alias("a"), S.strip_ensembl_version(F.concat(F.lit("X"), F.col("p_partkey"), F.lit(".3"))).alias("b"))


@query("u5_clean_dna", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE seq END AS clean FROM {PARTS}")
def u5(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("seq", F.lit("N"))).otherwise(F.lower(F.translate("seq", "T", "U")))
    return parts(t).select("p_partkey", S.clean_dna(raw).alias("clean"))


@query("u7_a7_region_parse", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_partkey AS BIGINT) AS a, CAST(l_partkey + l_linenumber AS BIGINT) AS b, 'chr' || l_suppkey AS name FROM lineitem WHERE l_partkey >= 1")
def u7(t: Tables) -> DataFrame:
    text = F.concat(F.lit("chr"), F.col("l_suppkey"), F.lit(":"), F.col("l_partkey"), F.lit("-"), F.col("l_partkey") + F.col("l_linenumber"))
    name, a, b = S.genome_region(text)
    return t.lineitem.select("l_orderkey", long("l_linenumber", "ln"), a.alias("a"), b.alias("b"), name.alias("name")).where("name is not null")


@query("u8_split_lists", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, string_split(p_name, ' ')[1] AS first FROM part")
def u8(t: Tables) -> DataFrame:
    items = S.split_list(F.regexp_replace("p_name", " ", " , "))
    return t.part.select("p_partkey", long(F.size(items), "n"), items[0].alias("first"))


@query("u12_cigar_length", "SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS span FROM lineitem GROUP BY l_orderkey".replace("AS span", "AS span").replace("sum(", "CAST(sum(").replace("l_linenumber)", "l_linenumber) AS BIGINT)"))
def u12(t: Tables) -> DataFrame:
    cigar = F.concat(F.col("l_quantity").cast("int"), F.lit("M3I"), F.col("l_linenumber"), F.lit("D5S"))
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(S.cigar_reference_length(cigar)).alias("span"))


@query("u13_flags", "SELECT o_orderkey, o_orderstatus = 'F' AS flag FROM orders")
def u13(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.truthy(F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("no")).alias("flag"))


@query("u14_cell_truncation", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS cell FROM documents")
def u14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.clipped("text", 50).alias("cell"))


@query("u15_occurrences", f"SELECT p_partkey, count(*) AS n, CAST(min(s) AS BIGINT) AS first FROM {PARTS}, generate_series(1, 31) a(s) WHERE substr(seq, CAST(s AS INT), 2) = 'AA' GROUP BY p_partkey")
def u15(t: Tables) -> DataFrame:
    at = S.occurrences("seq", F.lit("AA"))
    return parts(t).select("p_partkey", long(F.size(at), "n"), long(F.array_min(at), "first")).where("n > 0")


@query("u17_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def u17(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("a5_region_sequence", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, CASE WHEN l_returnflag = 'R' THEN {rc_sql('substr(seq, l_linenumber, 12)')} ELSE substr(seq, l_linenumber, 12) END AS seq FROM lineitem JOIN {PARTS} p ON p_partkey = l_partkey")
def a5(t: Tables) -> DataFrame:
    from ..sources.readers import region_sequence

    fasta = parts(t).select(F.concat(F.lit("chr"), F.col("p_partkey")).alias("name"), F.lower("seq").alias("seq"))
    reg = t.lineitem.select("l_orderkey", long("l_linenumber", "ln"), F.col("l_partkey").cast("string").alias("chrom"), F.col("l_linenumber").alias("st"), (F.col("l_linenumber") + 11).alias("en"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))
    return region_sequence(reg, fasta, "chrom", "st", "en", "strand").where("seq is not null").select("l_orderkey", "ln", "seq")


@query("a9_soft_mask", "SELECT p_partkey AS name, CAST(10 AS BIGINT) AS start0, CAST(16 AS BIGINT) AS end0 FROM part WHERE p_partkey % 2 = 0")
def a9(t: Tables) -> DataFrame:
    from ..sources.readers import soft_mask

    low = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("seq", 1, 10), F.lower(F.substring("seq", 11, 6)), F.substring("seq", 17, 16))).otherwise(F.col("seq"))
    return soft_mask(parts(t).select(F.col("p_partkey").alias("name"), low.alias("seq")))


@query("a13_transcript_records", "SELECT source AS transcript, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS tags FROM documents GROUP BY source")
def a13(t: Tables) -> DataFrame:
    from ..sources.readers import transcript_records

    out = transcript_records(t.documents.select(F.col("source").alias("Transcript_ID"), F.concat(F.lit(" "), F.col("lang")).alias("tags")))
    return out.select("transcript", "n", F.array_join("tags", ",").alias("tags"))


@query("a24_contig_lengths", "SELECT doc_id AS name, CAST(length(text) AS BIGINT) AS length FROM documents")
def a24(t: Tables) -> DataFrame:
    from ..sources.readers import contig_lengths

    return contig_lengths(t.documents.select(F.col("doc_id").alias("name"), F.col("text").alias("seq")))


@query("s1_flat_cells", "SELECT doc_id, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS text FROM documents")
def s1(t: Tables) -> DataFrame:
    from ..sources.writers import flat_cells

    return flat_cells(t.documents.select("doc_id", "text"))


@query("s6_fasta_lines", f"SELECT '>' || p_partkey || chr(10) || seq AS line FROM {PARTS}")
def s6(t: Tables) -> DataFrame:
    from ..sources.writers import fasta_lines

    return fasta_lines(parts(t).withColumn("name", F.col("p_partkey").cast("string")), "name", "seq").withColumnRenamed("value", "line")


@query("s7_table_to_annotation", f"SELECT 'T' || p_partkey || chr(9) || 'table' || chr(9) || k || chr(9) || '1' || chr(9) || length(seq) || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'gene_id \"' || p_brand || '\"; transcript_id \"T' || p_partkey || '\";' AS line FROM {PARTS}, (VALUES ('gene'), ('transcript'), ('exon')) v(k)")
def s7(t: Tables) -> DataFrame:
    from ..sources.writers import gtf_lines

    return gtf_lines(parts(t).select(F.col("p_brand").alias("gene"), F.concat(F.lit("T"), F.col("p_partkey")).alias("transcript"), "seq")).withColumnRenamed("value", "line")
