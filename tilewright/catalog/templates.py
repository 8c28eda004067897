"""Nine published designs as protocols, run from annotation, contigs and records that the given tables make.

Every 200 parts, in order of key, are a contig of their digests' bases. A contig of 40 parts or more has a gene g<n> on
strand + or, of odd number, -: transcript 1 (MANE and canonical) with the exons 101-500 and 701-1000, of which 201-500 and
701-900 are coding, and transcript 2 with the exon 101-300. The records are the transcripts; of every third gene also a
pseudogene that holds its first 500 bases, and of the next a coding gene with 120 of its bases, one of them changed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import thermo
from ..functions.sequence import digest_bases, reverse_complement
from ..plans import protocol
from ..session import kept, spread
from .base import Tables, bases_sql, query, rc_sql

FISH = {"temperature_c": 37, "na_mM": 390, "dntp_mM": 0}
RUNS = ["AAAAA", "TTTTT", "CCCCC", "GGGGG"]
#: Sequences that all targets' probes carry here.
INITIATORS, SPACERS = ("GAGGAGGGCAGCAAACGG", "GAAGAGTCTTCCTTTACG"), ("AA", "TA")
READOUTS = ["ATCCTCCTTCAATACATCCC", "ACACTACCACCATTTCCTAT", "ACTCCACTACTACTCACTCT", "ACCCTCTAACTTCCATCACA"]
PRIMERS = ("GTCTTATCATGTGCCTTTCCT", "CCCTATAGTGAGTCGTATTA")
BACKBONE, PADLOCK, LOOP = "TCTACGAGTTTGCAGTCACG", ("TGCGTCTATTTGT", "TAGTGGAGCCT", "AGGCTCCACTA"), ("AATTATTAC", "CATACACTAAAGATA", "TTATCTT")


def genes(spec: dict, **kind) -> dict:
    """The attribute that counts the genes hit on the sense strand."""
    return {"target": "target_region", "type": "mapped_genes", "aligner": "bowtie", "max_mismatches": 2, "strand": "sense"} | kind | spec


def gc(target: str) -> dict:
    return {"target": target, "type": "gc_content"}


def tm(target: str, **more) -> dict:
    return {"target": target, "type": "annealing_temperature"} | more


def between(name: str, low: float, high: float) -> dict:
    return {"condition": f"{name} >= {low} & {name} <= {high}"}


def design(region: dict, probes: dict, hybridization: dict, attributes: dict, filters: dict, sorts: list, overlap: dict, number: int | None) -> dict:
    post = {"filters": filters, "sorts": {"is_ascending": sorts}, "remove_overlap": overlap} | ({"equal_space": {"number_desired": number}} if number else {})
    return {"targets": ["all"], "extracts": {"target_region": region}, "probes": probes, "hybridization": hybridization, "attributes": attributes, "post_process": post}


ONE_GENE = {"target_mapped_genes": {"condition": "target_mapped_genes <= 1"}}
COPIES = {"exempt_copies": {"kmer": 30, "min_shared": 0.5}}
SIX = {"na_mM": 300, "mg_mM": 0, "dntp_mM": 0, "probe_nM": 5, "formamide_pct": 0}
PLAIN = SIX | {"na_mM": 50, "probe_nM": 50}
MRNA, CDS = {"source": "mRNA", "transcripts": "mane"}, {"source": "CDS", "transcripts": "mane"}


def sized(**parts) -> dict:
    return {"parts": {k: {"length": v} for k, v in parts.items()}}


DESIGNS = {
    "smfish": design(
        MRNA | {"length": 20, "step": 1}, {"smfish_probe": {"template": "{binding}", "parts": {"binding": {"expr": "rc(target_region)"}}}}, FISH | {"formamide_pct": 10, "probe_nM": 2.6},
        {"target_gc": gc("target_region"), "probe_tm": tm("smfish_probe.binding"), "target_mapped_genes": genes(COPIES)},
        ONE_GENE | {"target_gc": between("target_gc", 0.4, 0.6), "probe_tm": {"condition": "probe_tm >= 37"}}, ["target_mapped_genes"], {"location_interval": 3}, 48,
    ),
    "oligopaint": design(
        {"source": "genome", "length": [35, 41], "step": 1, "masked": "drop"},
        {"oligopaint_oligo": {"template": "{primer_1}{homology}{primer_2_rc}", "parts": {"primer_1": {"template": "N" * 21, "parts": {}}, "homology": {"expr": "target_region"}, "primer_2_rc": {"template": "N" * 21, "parts": {}}}}},
        {"temperature_c": 42, "na_mM": 390, "formamide_pct": 50, "dntp_mM": 0},
        {"homology_gc": gc("oligopaint_oligo.homology"), "homology_tm": tm("oligopaint_oligo.homology", tm_method="oligominer", hybridization={"na_mM": 390, "formamide_pct": 50, "probe_nM": 25}),
         "homology_kmer_count": {"target": "oligopaint_oligo.homology", "type": "kmer_count", "kmer_len": 18, "aligner": "jellyfish", "strand": "sense", "locus_only": True},
         "homology_sites": {"target": "oligopaint_oligo.homology", "type": "mapped_sites", "aligner": "bowtie2"}},
        {"homology_gc": between("homology_gc", 0.2, 0.8), "homology_tm": between("homology_tm", 42, 47), "homopolymers": {"type": "sequence_pattern", "target": "oligopaint_oligo.homology", "exclude_patterns": RUNS},
         "n_bases": {"type": "sequence_pattern", "target": "oligopaint_oligo.homology", "exclude_patterns": ["N"]}, "homology_kmer_count": {"condition": "homology_kmer_count <= 4"}, "homology_sites_num": {"condition": "homology_sites_num == 1"}},
        ["homology_kmer_count"], {"location_interval": 0}, None,
    ),
    "hcr": design(
        MRNA | {"length": 52, "step": 1, "layout": sized(left=25, gap=2, right=25)},
        {"probe_odd": {"template": "{initiator}{spacer}{binding}", "parts": {"initiator": {"expr": "encoding['all']['init_odd']"}, "spacer": {"expr": "encoding['all']['spacer_odd']"}, "binding": {"expr": "rc(target_parts['left'])"}}},
         "probe_even": {"template": "{binding}{spacer}{initiator}", "parts": {"binding": {"expr": "rc(target_parts['right'])"}, "spacer": {"expr": "encoding['all']['spacer_even']"}, "initiator": {"expr": "encoding['all']['init_even']"}}}},
        {"temperature_c": 37, "na_mM": 975, "probe_nM": 4, "formamide_pct": 30, "dntp_mM": 0},
        {"odd_gc": gc("probe_odd.binding"), "even_gc": gc("probe_even.binding"), "odd_tm": tm("probe_odd.binding"), "even_tm": tm("probe_even.binding"), "target_mapped_genes": genes({"oligos": ["left", "right"]})},
        ONE_GENE | {"odd_tm": {"condition": "odd_tm >= 37"}, "even_tm": {"condition": "even_tm >= 37"}}, ["target_mapped_genes"], {"location_interval": 2}, 20,
    ),
    "merfish": design(
        MRNA | {"length": 30, "step": 1},
        {"encoding_probe": {"template": "{primer_1}A{readout_1}{binding}A{readout_2}{readout_3}{primer_2_rc}", "parts": {
            "primer_1": {"template": "N" * 20, "parts": {}}, "binding": {"expr": "rc(target_region)"}, "primer_2_rc": {"template": "N" * 20, "parts": {}},
            **{f"readout_{k}": {"expr": f"rc(encoding['all']['readouts'][(probe_index + {k}) % 4])"} for k in (1, 2, 3)}}}},
        FISH | {"formamide_pct": 30},
        {"target_gc": gc("target_region"), "binding_tm": tm("encoding_probe.binding", tm_method="merfish_design", hybridization={"na_mM": 300, "probe_nM": 5}), "target_mapped_genes": genes(COPIES)},
        ONE_GENE | {"target_gc": between("target_gc", 0.43, 0.63), "binding_tm": between("binding_tm", 66, 76)}, ["target_mapped_genes"], {"location_interval": 0}, 92,
    ),
    "seqfish": design(
        CDS | {"length": 28, "step": 1},
        {"primary_probe": {"template": "{primer_fwd}{overhang_0}T{overhang_1}T{binding}T{overhang_2}T{overhang_3}{t7_rc}", "parts": {
            "primer_fwd": {"template": PRIMERS[0], "parts": {}}, "binding": {"expr": "rc(target_region)"}, "t7_rc": {"template": PRIMERS[1], "parts": {}},
            **{f"overhang_{k}": {"expr": f"rc(encoding['all']['readouts'][(probe_index + {k}) % 4])"} for k in range(4)}}}},
        FISH | {"probe_nM": 1, "formamide_pct": 40},
        {"target_gc": gc("target_region"), "binding_tm": tm("primary_probe.binding"), "target_mapped_genes": genes(COPIES)},
        ONE_GENE | {"target_gc": between("target_gc", 0.45, 0.65), "homopolymers": {"type": "sequence_pattern", "target": "target_region", "exclude_patterns": RUNS}}, ["target_mapped_genes"], {"location_interval": 2}, 24,
    ),
    "padlock": design(
        MRNA | {"length": 30, "step": 1, "layout": sized(arm_3_end=5, junction=20, arm_5_end=5)},
        {"padlock": {"template": "{arm_5}{id}" + BACKBONE + "{arm_3}", "parts": {"arm_5": {"expr": "target_region[15:30]"}, "id": {"expr": "encoding['all']['id']"}, "arm_3": {"expr": "target_region[0:15]"}}}},
        {"temperature_c": 45, "na_mM": 75, "mg_mM": 10, "probe_nM": 10, "formamide_pct": 20, "dntp_mM": 0},
        {"target_gc": gc("target_region"), "target_tm": tm("target_region", tm_method="multi_padlock_design", hybridization={"na_mM": 75, "mg_mM": 10, "probe_nM": 100, "formamide_pct": 20, "dntp_mM": 0}),
         "arm_5_tm": tm("padlock.arm_5"), "arm_3_tm": tm("padlock.arm_3"), "target_mapped_genes": genes({}), "junction_mapped_genes": genes({}, target="target_parts.junction", max_mismatches=1)},
        ONE_GENE | {"target_tm": between("target_tm", 65, 75), "junction_mapped_genes": {"condition": "junction_mapped_genes <= 1"}}, ["target_mapped_genes", "junction_mapped_genes"], {"location_interval": 15}, 5,
    ),
    "mipseq": design(
        MRNA | {"length": 40, "step": 1, "layout": sized(arm5_site=13, arm3_site=13, gap=1, primer_site=13)},
        {"padlock": {"template": "{arm_5}CC{b1}" + PADLOCK[0] + "{b2}" + PADLOCK[1] + "{arm_3}", "parts": {"arm_5": {"expr": "rc(target_parts['arm5_site'])"}, "b1": {"expr": "encoding['all']['b1']"}, "b2": {"expr": "encoding['all']['b2']"}, "arm_3": {"expr": "rc(target_parts['arm3_site'])"}}},
         "rca_primer": {"template": "{binding}{gap_base}" + PADLOCK[2], "parts": {"binding": {"expr": "rc(target_parts['primer_site'])"}, "gap_base": {"expr": "target_parts['gap']"}}}},
        FISH | {"probe_nM": 30, "formamide_pct": 10},
        {"target_gc": gc("target_region"), "arm_5_tm": tm("padlock.arm_5"), "arm_3_tm": tm("padlock.arm_3"), "primer_tm": tm("rca_primer.binding"), "target_mapped_genes": genes({"oligos": [["arm5_site", "arm3_site"], "primer_site"]})},
        ONE_GENE | {"near_5p": {"condition": "target_start <= 1000"}, **{k: {"condition": f"{k} >= 28"} for k in ("arm_5_tm", "arm_3_tm", "primer_tm")}}, ["target_mapped_genes"], {"location_interval": 0}, 2,
    ),
    "starmap": design(
        CDS | {"length": [40, 46], "step": 1, "layout": sized(padlock_site=[19, 25], gap=[1, 2], primer_site=[19, 25])},
        {"padlock": {"template": "A{code_5}TA{binding}" + LOOP[0] + "{code}" + LOOP[1], "parts": {"code_5": {"expr": "encoding['all']['code']"}, "binding": {"expr": "rc(target_parts['padlock_site'])"}, "code": {"expr": "encoding['all']['code']"}}},
         "primer": {"template": "{binding}TA{code_rc}" + LOOP[2], "parts": {"binding": {"expr": "rc(target_parts['primer_site'])"}, "code_rc": {"expr": "rc(encoding['all']['code'])"}}}},
        {"temperature_c": 40, "na_mM": 390, "probe_nM": 100, "formamide_pct": 10, "dntp_mM": 0},
        {"padlock_tm": tm("padlock.binding", hybridization=SIX), "primer_tm": tm("primer.binding", hybridization=SIX), "padlock_gc": gc("padlock.binding"), "primer_gc": gc("primer.binding"),
         "tm_balance": {"type": "difference", "of": ["padlock_tm", "primer_tm"]}, "target_mapped_genes": genes({"oligos": ["padlock_site", "primer_site"]})},
        ONE_GENE | {"padlock_tm": between("padlock_tm", 56, 70), "primer_tm": between("primer_tm", 56, 70)}, ["target_mapped_genes"], {"location_interval": 0, "prefer": "tm_balance"}, 4,
    ),
    "double_hyb": design(
        CDS | {"length": 40, "step": 20, "layout": sized(arm_site=26, gap=1, primer_site=13)},
        {"circle_probe": {"template": "{part1}{part2}{part3}", "parts": {"part1": {"expr": "rc(target_region[0:13])"}, "part3": {"expr": "rc(target_region[13:26])"},
                          "part2": {"template": "{barcode1}N{barcode2}", "parts": {"barcode1": {"expr": "encoding['all']['barcodes'][0]"}, "barcode2": {"expr": "encoding['all']['barcodes'][1]"}}}}},
         "amp_probe": {"template": "{part2}N{part1}", "parts": {"part1": {"expr": "rc(circle_probe.part2.barcode2)"}, "part2": {"expr": "rc(target_region[-13:])"}}}},
        FISH | {"formamide_pct": 10, "probe_nM": 30},
        {"fold_score": {"target": "circle_probe:part1", "type": "fold_score"}, "n_mapped_genes": {"target": "target_region", "type": "mapped_genes", "aligner": "bowtie2", "strand": "sense"}, "arm_mapped_genes": genes({}, target="target_parts.arm_site"),
         "target_gc_content": gc("target_region"), "tm1": tm("circle_probe:part1", hybridization=PLAIN), "tm2": tm("circle_probe:part3", hybridization=PLAIN), "tm3": tm("amp_probe:part2", hybridization=PLAIN),
         "circle_fold_score": {"target": "circle_probe", "type": "fold_score"}, "amp_fold_score": {"target": "amp_probe", "type": "fold_score"}},
        {**{k: between(k, 35, 45) for k in ("tm1", "tm2", "tm3")}, **{k: {"condition": f"{k} <= 1"} for k in ("n_mapped_genes", "arm_mapped_genes")}}, ["circle_fold_score", "amp_fold_score", "tm1"], {"location_interval": 0}, None,
    ),
}
ENCODING = {"all": {"init_odd": INITIATORS[0], "init_even": INITIATORS[1], "spacer_odd": SPACERS[0], "spacer_even": SPACERS[1], "readouts": READOUTS, "id": "TAGACGTAGTGAGCATGACT", "b1": "GAG", "b2": "CAT", "code": "AAA", "barcodes": ["GATTACAGCCTTAGCAT", "CTTGACCAGTACGTTGA"]}}

SEGMENTS = {"T1": {"exon": [(101, 500), (701, 1000)], "CDS": [(201, 500), (701, 900)]}, "T2": {"exon": [(101, 300)]}}
PER_CONTIG, LEAST = 200, 40


def inputs(t: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Targets and tables of a run, as the module's head says."""
    one = t.part.select(F.floor(F.col("p_partkey") / PER_CONTIG).alias("c"), "p_partkey", digest_bases("p_partkey").alias("b"))
    contigs = one.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "b"))), lambda x: x["b"]), "").alias("seq"), (F.count("*") >= LEAST).alias("whole"))
    contigs = kept(spread(contigs, "c"))
    name, strand = F.concat(F.lit("chr"), "c"), F.when(F.col("c") % 2 == 1, "-").otherwise("+")
    rows = [(tr, kind, a, b) for tr, kinds in SEGMENTS.items() for kind, places in kinds.items() for a, b in places]
    parts = F.explode(F.array(*[F.struct(F.lit(tr).alias("tr"), F.lit(k).alias("type"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for tr, k, a, b in rows]))
    tags = F.when(F.col("x.tr") == "T1", F.array(F.lit("MANE_Select"), F.lit("Ensembl_canonical"))).otherwise(F.array().cast("array<string>"))
    annotation = contigs.where("whole").select("c", parts.alias("x")).select(F.col("c").cast("string").alias("chr"), "x.type", "x.start", "x.end", strand.alias("strand"), F.concat(F.lit("g"), "c").alias("gene_name"), F.concat(F.lit("T"), "c", F.lit("."), F.substring("x.tr", 2, 1)).alias("transcript_id"), tags.alias("tags"))

    def spliced(places: list) -> F.Column:
        joined = F.concat(*[F.substring(F.col("seq"), F.lit(a), F.lit(b - a + 1)) for a, b in places])
        return F.when(F.col("c") % 2 == 1, reverse_complement(joined)).otherwise(joined)

    m = contigs.where("whole").select("c", spliced(SEGMENTS["T1"]["exon"]).alias("m"), spliced(SEGMENTS["T2"]["exon"]).alias("m2"))
    changed = F.concat(F.substring("m", 51, 60), F.translate(F.substring("m", 111, 1), "ACGT", "CGTA"), F.substring("m", 112, 59))
    found = F.array_compact(F.array(
        F.struct(F.concat(F.lit("g"), "c", F.lit("_1")).alias("record"), F.col("m").alias("seq")), F.struct(F.concat(F.lit("g"), "c", F.lit("_2")).alias("record"), F.col("m2").alias("seq")),
        F.when(F.col("c") % 3 == 0, F.struct(F.concat(F.lit("p"), "c", F.lit("_1")).alias("record"), F.substring("m", 1, 500).alias("seq"))),
        F.when(F.col("c") % 3 == 1, F.struct(F.concat(F.lit("q"), "c", F.lit("_1")).alias("record"), changed.alias("seq"))),
    ))
    records = m.select(F.explode(found).alias("x")).select("x.*")
    names = records.select(F.substring_index("record", "_", 1).alias("gene")).distinct()
    names = names.select("gene", F.col("gene").alias("label"), F.when(F.col("gene").startswith("p"), "processed_pseudogene").otherwise("protein_coding").alias("biotype"))
    fasta = contigs.select(name.alias("name"), F.when(F.col("c") % 5 == 2, F.concat(F.substring("seq", 1, 1200), F.lower(F.substring("seq", 1201, 60)), F.substring(F.col("seq"), F.lit(1261), F.length("seq")))).otherwise(F.col("seq")).alias("seq"))
    targets = annotation.select(F.col("gene_name").alias("target")).distinct()
    genome = contigs.select(F.col("c").cast("string").alias("record"), "seq")
    mask = contigs.where("c % 2 = 0").select(name.alias("chrom"), F.lit(1500).cast("long").alias("start0"), F.lit(1510).cast("long").alias("end0"))
    return targets, {"annotation": annotation, "contigs": fasta, "records": records, "genes": names, "genome": genome, "mask": mask}


#: The region of each contig that the design on the genome reads.
LOCUS = (1001, 2000)

_C = f"c AS (SELECT p_partkey // {PER_CONTIG} AS c, string_agg(b, '' ORDER BY p_partkey) AS seq, count(*) >= {LEAST} AS whole FROM (SELECT p_partkey, {bases_sql('p_partkey')} AS b FROM part) GROUP BY 1)"


def _spliced_sql(places: list) -> str:
    joined = " || ".join(f"substr(seq, {a}, {b - a + 1})" for a, b in places)
    return f"CASE WHEN c % 2 = 1 THEN {rc_sql(f'({joined})')} ELSE {joined} END"


_M = f"m AS (SELECT c, {_spliced_sql(SEGMENTS['T1']['exon'])} AS m, {_spliced_sql(SEGMENTS['T2']['exon'])} AS m2, {_spliced_sql(SEGMENTS['T1']['CDS'])} AS cds FROM c WHERE whole)"
_REC = """rec AS (SELECT 'g' || c AS gene, m AS r FROM m UNION ALL SELECT 'g' || c, m2 FROM m UNION ALL SELECT 'p' || c, substr(m, 1, 500) FROM m WHERE c % 3 = 0
  UNION ALL SELECT 'q' || c, substr(m, 51, 60) || translate(substr(m, 111, 1), 'ACGT', 'CGTA') || substr(m, 112, 59) FROM m WHERE c % 3 = 1)"""


def _pairs_sql(x: str, table: dict, i: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in table.items())
    return f"list_sum(list_transform(generate_series(1, length({x}) - 1), lambda i: CASE substr({x}, CAST(i AS INT), 2) {cases} END))"


def _at_sql(x: str) -> str:
    return f"(CAST(substr({x}, 1, 1) IN ('A', 'T') AS INT) + CAST(substr({x}, -1) IN ('A', 'T') AS INT))"


def _gc_sql(x: str) -> str:
    return f"(length({x}) - length(replace(replace({x}, 'G', ''), 'C', ''))) / CAST(length({x}) AS DOUBLE)"


def _tm_sql(x: str, h: dict, method: str = "primer") -> str:
    """As ``protocol.ATTRIBUTES`` computes it under the conditions ``h``."""
    at, n = _at_sql(x), f"length({x})"
    if method == "multi_padlock_design":
        salt = 16.6 * math.log10(h["na_mM"] / 1000 + 3.795 * math.sqrt(h["mg_mM"] / 1000))
        return f"({_pairs_sql(x, thermo.SUGIMOTO_1996, 0)} + 0.6e0) * 1000 / ({_pairs_sql(x, thermo.SUGIMOTO_1996, 1)} - 9.0e0 + {1.9872 * math.log(h['probe_nM'] * 1e-9)!r}) - 273.15e0 + {salt!r} - {0.72 * h['formamide_pct']!r}"
    if method == "merfish_design":
        return f"({_pairs_sql(x, thermo.SANTALUCIA_2004, 0)} + {at} * 2.2e0 + 0.2e0) * 1000 / ({_pairs_sql(x, thermo.SANTALUCIA_2004, 1)} + {at} * 6.9e0 - 5.7e0 + ({n} - 1) * {0.368 * math.log(h['na_mM'] / 1000)!r} + {1.9872 * math.log(h['probe_nM'] * 1e-9)!r}) - 273.15e0"
    enthalpy, entropy = f"({_pairs_sql(x, thermo.SANTALUCIA_1998, 0)} + {at} * 2.3e0 + (2 - {at}) * 0.1e0)", f"{_pairs_sql(x, thermo.SANTALUCIA_1998, 1)} + {at} * 4.1e0 - (2 - {at}) * 2.8e0"
    if method == "oligominer":
        return f"round({enthalpy} * 1000 / ({entropy} + ({n} - 1) * {0.368 * math.log(h['na_mM'] / 1000)!r} + {1.987 * math.log(h['probe_nM'] / 2 * 1e-9)!r}) - 273.15e0, 2) - {0.65 * h['formamide_pct']!r}"
    same = f"({x} = {rc_sql(x)})"
    ion = h["na_mM"] + 120 * math.sqrt(max(h["mg_mM"] - h["dntp_mM"], 0))
    rate = f"CASE WHEN {same} THEN {1.987 * math.log(h['probe_nM'] / 1e9) - 1.4!r} ELSE {1.987 * math.log(h['probe_nM'] / 4e9)!r} END"
    return f"{enthalpy} * 1000 / ({entropy} + ({n} - 1) * {0.368 * math.log(ion / 1000)!r} + {rate}) - 273.15e0 - (2.88e0 - ({_gc_sql(x)}) * 0.453e0) * {h['formamide_pct'] * 11.33 / 45.04!r}"


def _hits_sql(name: str, oligos: list[str], mismatches: int, copies: bool) -> str:
    """For each target and tuple of oligos the genes of which one record is hit by all."""
    words = " UNION ".join(f"SELECT {o} AS o FROM f" for o in oligos)
    exempt = " AND NOT (x0.gene LIKE 'p%' AND (u.target, x0.gene) IN (SELECT target, gene FROM shared))" if copies else ""
    joins = " ".join(f"JOIN s{name} x{k} ON x{k}.o = u.{o}{f' AND x{k}.id = x0.id' if k else exempt}" for k, o in enumerate(oligos))
    keys = ", ".join(f"u.{o}" for o in oligos)
    return f"""o{name} AS ({words}),
k{name} AS (SELECT DISTINCT id, gene, n, substr(r, CAST(i AS INT), CAST(n AS INT)) AS k FROM (SELECT gene, r, row_number() OVER (ORDER BY gene, r) AS id FROM rec), (SELECT DISTINCT length(o) AS n FROM o{name}), generate_series(1, 700) x(i) WHERE i + n - 1 <= length(r)),
s{name} AS (SELECT DISTINCT o, gene, id FROM o{name} JOIN k{name} ON length(o) = n AND hamming(o, k) <= {mismatches}),
{name} AS (SELECT u.target, {keys}, count(DISTINCT x0.gene) AS n FROM (SELECT DISTINCT target, {", ".join(oligos)} FROM f) u {joins} GROUP BY u.target, {keys})"""


_SHARED = """t30 AS (SELECT DISTINCT target, substr(seq, CAST(i AS INT), 30) AS k FROM s, generate_series(1, 700) x(i) WHERE i + 29 <= length(seq)),
r30 AS (SELECT DISTINCT gene, substr(r, CAST(i AS INT), 30) AS k FROM rec, generate_series(1, 700) x(i) WHERE i + 29 <= length(r) AND gene LIKE 'p%'),
shared AS (SELECT target, gene FROM t30 JOIN r30 USING (k) JOIN (SELECT target, count(*) AS n FROM t30 GROUP BY target) USING (target) GROUP BY target, gene HAVING count(*) >= 0.5 * any_value(n))"""


def _sql(source: str, low: int, high: int, words: dict[str, str], tests: list[str], hits: list[str], counts: list[str], gap: int, number: int | None, out: dict[str, str], prefer: str = "0", layouts: str = "", sizes: str = "", copies: bool = False, warm: dict[str, str] | None = None) -> str:
    """A design in SQL: windows, words, tests, hits, the greedy pass, even spacing, what is returned."""
    named = "".join(f", {x} AS {k}" for k, x in words.items())
    want = number or 1_000_000_000
    joined = " ".join(f"JOIN h{k} ON h{k}.target = f.target AND {' AND '.join(f'h{k}.{o} = f.{o}' for o in keys)} AND h{k}.n <= 1" for k, keys in enumerate(counts))
    shared = f"{_SHARED},\n" if copies else ""
    chain = "".join(f"{h},\n" for h in hits)
    temperatures = ""
    if warm:  # of distinct words, once each
        words_ = " UNION ".join(f"SELECT {x} AS o FROM p0" for x in warm.values())
        temperatures = f"z AS (SELECT o, {rc_sql('o')} AS x FROM ({words_})), t AS (SELECT o, {_tm_sql('x', SIX)} AS tm FROM z),\np AS (SELECT p0.*{''.join(f', t{k}.tm AS {k}' for k in warm)} FROM p0 {' '.join(f'JOIN t t{k} ON t{k}.o = p0.{x}' for k, x in warm.items())}),\n"
    return f"""
WITH RECURSIVE {_C}, {_M}, {_REC},
s AS (SELECT 'g' || c AS target, {source} AS seq FROM m),
w AS (SELECT target, CAST(i AS BIGINT) AS start, CAST(k AS BIGINT) AS size, substr(seq, CAST(i AS INT), CAST(k AS INT)) AS tr FROM s, generate_series(1, 700) x(i), generate_series({low}, {high}) y(k) WHERE i + k - 1 <= length(seq)),
l AS (SELECT * FROM w{layouts}),
{"p0" if warm else "p"} AS (SELECT *{named} FROM l),
{temperatures}f AS (SELECT * FROM p WHERE {' AND '.join(tests)}),
{shared}{chain}
g AS (SELECT f.*, row_number() OVER (PARTITION BY f.target ORDER BY f.start, {prefer}, f.size{sizes}) AS rn FROM f {joined}),
r AS (SELECT target, start, rn, start + size - 1 AS last, true AS keep FROM g WHERE rn = 1
  UNION ALL SELECT g.target, g.start, g.rn, CASE WHEN g.start > r.last + {gap} THEN g.start + g.size - 1 ELSE r.last END, g.start > r.last + {gap} FROM r JOIN g ON g.target = r.target AND g.rn = r.rn + 1),
k AS (SELECT g.*, row_number() OVER (PARTITION BY g.target ORDER BY g.start) - 1 AS nth, count(*) OVER (PARTITION BY g.target) AS n FROM r JOIN g USING (target, rn) WHERE keep),
e AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY start) - 1 AS number FROM k WHERE n <= {want} OR nth = n - 1 OR nth IN (SELECT CAST(floor(i * ((n - 1) / CAST({max(want - 1, 1)} AS DOUBLE))) AS BIGINT) FROM generate_series(0, {min(want, 1000) - 2}) x(i)))
SELECT target, start, {', '.join(f'{x} AS {c}' for c, x in out.items())} FROM e"""


def _conditions(name: str, attribute: str) -> dict:
    return protocol.conditions(DESIGNS[name], DESIGNS[name]["attributes"][attribute])


def _readout(k: int, shift: int = 0) -> str:
    return rc_sql("[" + ", ".join(f"'{x}'" for x in READOUTS) + f"][CAST((number + {k + shift}) % 4 AS INT) + 1]")


RC = rc_sql("tr")
_LAYOUT = ", generate_series(19, 25) a(pa), generate_series(1, 2) b(pb), generate_series(19, 25) d(pd) WHERE pa + pb + pd = size"
SQL = {
    "smfish": _sql("m", 20, 20, {"bind": RC}, [f"{_gc_sql('tr')} BETWEEN 0.4e0 AND 0.6e0", f"{_tm_sql('bind', _conditions('smfish', 'probe_tm'))} >= 37"], [_hits_sql("h0", ["tr"], 2, True)], [["tr"]], 3, 48, {"smfish_probe": "bind"}, copies=True),
    "hcr": _sql("m", 52, 52, {"a": "substr(tr, 1, 25)", "b": "substr(tr, 28)"}, [f"{_tm_sql(x, _conditions('hcr', 'odd_tm'))} >= 37" for x in (rc_sql("substr(tr, 1, 25)"), rc_sql("substr(tr, 28)"))], [_hits_sql("h0", ["a", "b"], 2, False)], [["a", "b"]], 2, 20,
                {"probe_odd": f"'{INITIATORS[0]}{SPACERS[0]}' || {rc_sql('a')}", "probe_even": f"{rc_sql('b')} || '{SPACERS[1]}{INITIATORS[1]}'"}),
    "merfish": _sql("m", 30, 30, {"bind": RC}, [f"{_gc_sql('tr')} BETWEEN 0.43e0 AND 0.63e0", f"{_tm_sql('bind', _conditions('merfish', 'binding_tm'), 'merfish_design')} BETWEEN 66 AND 76"], [_hits_sql("h0", ["tr"], 2, True)], [["tr"]], 0, 92,
                    {"encoding_probe": f"'{'N' * 20}A' || {_readout(1)} || bind || 'A' || {_readout(2)} || {_readout(3)} || '{'N' * 20}'"}, copies=True),
    "seqfish": _sql("cds", 28, 28, {"bind": RC}, [f"{_gc_sql('tr')} BETWEEN 0.45e0 AND 0.65e0", f"NOT regexp_matches(tr, '{'|'.join(RUNS)}')"], [_hits_sql("h0", ["tr"], 2, True)], [["tr"]], 2, 24,
                    {"primary_probe": f"'{PRIMERS[0]}' || {_readout(0)} || 'T' || {_readout(1)} || 'T' || bind || 'T' || {_readout(2)} || 'T' || {_readout(3)} || '{PRIMERS[1]}'"}, copies=True),
    "padlock": _sql("m", 30, 30, {"mid": "substr(tr, 6, 20)"}, [f"{_tm_sql('tr', _conditions('padlock', 'target_tm'), 'multi_padlock_design')} BETWEEN 65 AND 75"], [_hits_sql("h0", ["tr"], 2, False), _hits_sql("h1", ["mid"], 1, False)], [["tr"], ["mid"]], 15, 5,
                    {"padlock": f"substr(tr, 16) || 'TAGACGTAGTGAGCATGACT{BACKBONE}' || substr(tr, 1, 15)"}),
    "mipseq": _sql("m", 40, 40, {"a": "substr(tr, 1, 26)", "b": "substr(tr, 28)"}, [f"{_tm_sql(rc_sql(x), _conditions('mipseq', 'arm_5_tm'))} >= 28" for x in ("substr(tr, 1, 13)", "substr(tr, 14, 13)", "substr(tr, 28)")], [_hits_sql("h0", ["a", "b"], 2, False)], [["a", "b"]], 0, 2,
                   {"padlock": f"{rc_sql('substr(tr, 1, 13)')} || 'CCGAG{PADLOCK[0]}CAT{PADLOCK[1]}' || {rc_sql('substr(tr, 14, 13)')}", "rca_primer": f"{rc_sql('b')} || substr(tr, 27, 1) || '{PADLOCK[2]}'"}),
    "starmap": _sql("cds", 40, 46, {"a": "substr(tr, 1, CAST(pa AS INT))", "b": "substr(tr, CAST(pa + pb AS INT) + 1)"},
                    ["ta BETWEEN 56 AND 70", "tb BETWEEN 56 AND 70"], [_hits_sql("h0", ["a", "b"], 2, False)], [["a", "b"]], 0, 4,
                    {"padlock": f"'AAAATA' || {rc_sql('a')} || '{LOOP[0]}AAA{LOOP[1]}'", "primer": f"{rc_sql('b')} || 'TATTT{LOOP[2]}'"}, prefer="round(abs(f.ta - f.tb), 9)", layouts=_LAYOUT, sizes=", f.pa, f.pb, f.pd", warm={"ta": "a", "tb": "b"}),
}


def run(name: str, t: Tables) -> DataFrame:
    targets, tables = inputs(t)
    if DESIGNS[name]["extracts"]["target_region"]["source"] == "genome":
        targets = tables["contigs"].where(F.length("seq") >= LOCUS[1]).select(F.concat("name", F.lit(f":{LOCUS[0]}-{LOCUS[1]}")).alias("target"))
    out = protocol.run(DESIGNS[name] | {"encoding": ENCODING}, targets, tables)
    return out.select("target", F.col(protocol.bounds_of(out)[0]).alias("start"), *DESIGNS[name]["probes"])


for _name in DESIGNS:
    query(f"p_{_name}", SQL.get(_name))(lambda t, name=_name: run(name, t))
