"""The expression language, protocols, readers and writers."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import seeds
from tilewright.plans import finishing, protocol
from tilewright.plans.expression import ExpressionError, Typed, compile_expression, problems, references
from tilewright.sources import readers, writers
from tilewright.streaming.scoring import score_stream


@pytest.fixture
def scope(spark):
    return {"s": Typed(F.col("s"), "text"), "n": Typed(F.col("n"), "number")}


def test_slices_as_in_python(spark, scope):
    r = random.Random(1)
    texts = ["".join(r.choice("ACGT") for _ in range(k)) for k in (0, 1, 5, 12)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "s string, n int").cache()
    for _ in range(25):
        a, b = (r.choice(["", *map(str, range(-14, 15))]) for _ in range(2))
        e = f"s[{a}:{b}{r.choice(['', '', ':2', ':-1', ':-3', ':3'])}]"
        got = {x["s"]: x["x"] for x in df.select("s", compile_expression(e, scope).column.alias("x")).collect()}
        assert got == {t: eval(e, {"s": t}) for t in texts}, e  # noqa: S307


def test_numbers_as_in_python(spark, scope):
    df = spark.createDataFrame([("ACGT", k) for k in range(-7, 8)], "s string, n int")
    for e in ("n % 3", "-n % 4", "n % -3", "n + 2 % 5"):
        assert all(x["x"] == eval(e, {"n": x["n"]}) for x in df.select("n", compile_expression(e, scope).column.alias("x")).collect()), e  # noqa: S307
    assert [x["x"] for x in df.where("n = 0").select(compile_expression("n % 0", scope).column.alias("x")).collect()] == [None]


def test_expression_errors(scope):
    for e in ("s + n", "s * 2", "open(s)", "s.upper()", "t[0]", "n[0]", "-s", "rc(n)"):
        with pytest.raises(ExpressionError):
            compile_expression(e, scope)
    assert problems("__import__('os')", set()) and problems("s[0:2", {"s"}) and not problems("rc(s[0:2]) + 'A'", {"s"})
    assert references("encoding[target]['x'][i % 2] + target_parts.left") == ["encoding", "target", "i", "target_parts.left"]


def test_probe_graph(spark):
    df = spark.createDataFrame([("ACGTACGTAC", "x"), ("TTTTTTTTTT", "y")], "target_region string, target string")
    probes = {"second": {"template": "{a}", "parts": {"a": {"expr": "first[0:4]"}}}, "first": {"template": "{p}{q}", "parts": {"p": {"expr": "rc(target_region[0:3])"}, "q": {"expr": "encoding[target]['b']"}}}}
    got = {x["target"]: (x["first"], x["second"]) for x in protocol.construct(df, probes, {"x": {"b": "GG"}}).collect()}
    assert got == {"x": ("CGTGG", "CGTG"), "y": ("AAA", "AAA")}
    with pytest.raises(ValueError):
        protocol.ordered(protocol.nodes({"a": {"expr": "b[0:2]"}, "b": {"expr": "a[0:2]"}}))


def test_protocol_problems_and_defaults(spark, tmp_path):
    p = {"targets": [], "extracts": {"target_region": {"length": 8}}, "probes": {"probe": {"expr": "target_regoin[0:4]"}}, "attributes": {"gc": {"type": "gc_contnt", "target": "target_region"}}, "post_process": {"filters": {"f": {"condition": "gcc > 1"}}}}
    text = " ".join(protocol.analyse(p))
    assert "target_regoin" in text and "gc_content" in text and "gcc" in text
    assert protocol.analyse({}) and protocol.clean_names([" a ", "a", "", "b"]) == ["a", "b"]
    good = protocol.with_defaults({"targets": [], "extracts": {"target_region": {"length": 8, "layout": {"parts": {"l": {"length": [3, 4]}, "r": {"length": [4, 5]}}}}}, "probes": {"probe": {"expr": "rc(target_parts.l)"}}, "post_process": {"equal_space": {"number_desired": 2}}})
    out = protocol.run(good, spark.createDataFrame([("t", "ACGTACGTTGCAGGATCCAT")], "target string, seq string")).collect()
    assert 0 < len(out) <= 2 and all(x["probe"] for x in out)
    twice = tmp_path / "p.yaml"
    twice.write_text("a: 1\na: 2\n")
    with pytest.raises(ValueError):
        protocol.load(str(twice))


def test_stream_scoring(spark, tmp_path):
    spark.createDataFrame([("ACGTACGT",)], "target_region string").write.json(str(tmp_path / "in"))
    p = {"probes": {"probe": {"expr": "rc(target_region[0:4])"}}, "attributes": {"gc": {"type": "gc_content", "target": "probe"}}}
    q = score_stream(spark.readStream.schema("target_region string").json(str(tmp_path / "in")), p).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert [(x["probe"], x["gc"]) for x in spark.table("scored").collect()] == [("ACGT", 0.5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#!x\nchr1\tens\texon\t11\t20\t.\t+\t.\tgene_id "G1.2"; gene_name "N"; transcript_id "T1"; tag "MANE_Select"; tag "basic";\n1\tens\texon\t31\t35\t.\t-\t.\tgene "M"; Dbxref "GeneID:77";\n')
    g = readers.read_gtf(spark, str(tmp_path / "a.gtf")).orderBy("start").collect()
    assert [(x["chr"], x["gene_id"], x["gene_name"], x["length"], x["tags"]) for x in g] == [("1", "G1.2", "N", 10, ["MANE_Select", "basic"]), ("1", "GeneID:77", "M", 5, [])]
    assert readers.gene_table(readers.read_gtf(spark, str(tmp_path / "a.gtf"))).count() == 2
    (tmp_path / "a.fa").write_text(">chr1 text\nACGT\nacgtN\n>2\nGG\n")
    fasta = readers.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {tuple(x) for x in fasta.collect()} == {("chr1", "ACGTacgtN"), ("2", "GG")}
    assert {tuple(x) for x in readers.soft_mask(fasta).collect()} == {("chr1", 4, 9)}
    assert {tuple(x) for x in readers.contig_lengths(fasta).collect()} == {("chr1", 9), ("2", 2)}
    (tmp_path / "m.bed").write_text("track x\n# c\nchr1\t3\t9\n")
    assert [tuple(x) for x in readers.read_bed(spark, str(tmp_path / "m.bed")).collect()] == [("chr1", 3, 9)]
    (tmp_path / "e.gct").write_text("#1.2\n2\t1\nName\tDescription\tTPM\nA.1\tx\t1.5\nB\ty\t2\n")
    e = readers.read_expression(spark, str(tmp_path / "e.gct"))
    assert e.columns == ["Name", "Description", "TPM"] and readers.value_column(e, ["Name"]) == "TPM"
    with pytest.raises(ValueError):
        readers.value_column(e, ["Name"], "Description")
    assert readers.identifier_kind(e, "Name", {"letter": "^[A-Z]"}) == "letter"
    (tmp_path / "a.sam").write_text("@HD\nq1\t16\tr\t5\t0\t3M2D1I4M\t*\t0\t0\tA\tI\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert [tuple(x) for x in readers.read_sam(spark, str(tmp_path / "a.sam")).collect()] == [("q1", "-", "r", 4, 13)]
    assert [tuple(x) for x in readers.inline_targets(spark, ["a", {"b": "AC"}, "a"]).orderBy("ordinal").collect()] == [(0, "a", None), (1, "b", "AC")]
    df = spark.createDataFrame([("x\ty", [1, 2]), (None, [])], "t string, l array<int>")
    writers.write_tsv(df, str(tmp_path / "out"))
    assert {tuple(x) for x in readers.result_table(spark, str(tmp_path / "out")).collect()} == {("x y", "[1,2]"), (None, "[]")}
    writers.write_fasta(fasta, str(tmp_path / "fa"), "name", "seq")
    assert {tuple(x) for x in readers.read_fasta(spark, str(tmp_path / "fa")).collect()} == {("chr1", "ACGTacgtN"), ("2", "GG")}
    writers.write_fastq(fasta, str(tmp_path / "fq"), "name", "seq")
    writers.write_summary({"n": 1}, str(tmp_path / "s.json"))
    assert "schema_version" in (tmp_path / "s.json").read_text()


def test_protocol_keeps_the_order_of_extraction(spark):
    """Windows of 8 to 10 bases over 24, no gap: at each free start the shortest comes first."""
    p = {"targets": [], "extracts": {"target_region": {"length": [8, 10]}}, "probes": {"probe": {"expr": "rc(target_region)"}}, "post_process": {"remove_overlap": {"location_interval": 0}}}
    out = protocol.run(p, spark.createDataFrame([("t", "ACGTACGTTGCAGGATCCATTGCA")], "target string, seq string")).collect()
    assert sorted((r["start"], r["end"]) for r in out) == [(1, 8), (9, 16), (17, 24)]
    assert sorted(r["final_index"] for r in out) == [0, 1, 2]


def test_protocol_searches_other_tables(spark):
    a, b = "ACGTTGCAGGATCCATTGCAAGTC", "TTGACCGGTATACGCTTAGGCATC"
    targets = spark.createDataFrame([("a", a), ("b", b)], "target string, seq string")
    records = spark.createDataFrame([("a_1", a), ("b_1", b), ("c_1", "GG" + a[:12] + "CC"), ("d_1", b[12:])], "record string, seq string")
    genes = spark.createDataFrame([("a", "A", "protein_coding"), ("b", "B", "protein_coding"), ("c", "C", "protein_coding"), ("d", "D", "lncRNA")], "gene string, label string, biotype string")
    spec = {"type": "mapped_genes", "target": "target_region", "max_mismatches": 0, "strand": "sense"}
    p = {"targets": [], "extracts": {"target_region": {"length": 12, "step": 12}}, "probes": {"probe": {"expr": "rc(target_region)"}}, "attributes": {"hits": spec}, "post_process": {"filters": {"f": {"condition": "hits <= 1"}}}}

    def kept(p, tables):
        return sorted((r["target"], r["start"]) for r in protocol.run(p, targets, tables).collect())

    assert kept(p, {"records": records, "genes": genes}) == [("a", 13), ("b", 1)]
    with pytest.raises(ValueError, match="records"):
        protocol.run(p, targets)
    # the part of d that copies b, and is no coding gene, is exempt; c is a coding one
    exempt = p | {"attributes": {"hits": spec | {"exempt_copies": {"kmer": 6, "min_shared": 0.3}}}}
    assert kept(exempt, {"records": records, "genes": genes}) == [("a", 13), ("b", 1), ("b", 13)]
    # genes that are not expressed do not count
    expression = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("c", 0.0), ("d", 5.0)], "gene string, value double")
    silent = p | {"gene_expression": {"min_value": 1}}
    assert kept(silent, {"records": records, "genes": genes, "expression": expression}) == [("a", 1), ("a", 13), ("b", 1)]
    pooled = p | {"post_process": {"off_target_pool": {"attribute": "hits", "max_probes_per_gene": 0}}}
    assert kept(pooled, {"records": records, "genes": genes}) == [("a", 13), ("b", 1)]
    k = p | {"attributes": {"n": {"type": "kmer_count", "target": "target_region", "kmer_len": 12, "strand": "sense", "locus_only": True}}, "post_process": {"filters": {"f": {"condition": "n <= 1"}}}}
    assert kept(k, {"genome": records}) == [("a", 13), ("b", 1)]
    sites = p | {"attributes": {"s": {"type": "mapped_sites", "target": "target_region", "strand": "sense"}}, "post_process": {"filters": {"f": {"condition": "s_num == 1"}}}}
    assert kept(sites, {"genome": records}) == [("a", 13), ("b", 1)]
    index = seeds.write_index(records, "record", "seq", 6)
    assert kept(p, {"records": records, "records_index": index, "genes": genes}) == [("a", 13), ("b", 1)]
    assert kept(sites, {"genome": records, "genome_index": index}) == [("a", 13), ("b", 1)]
    peaks = sites | {"post_process": {"avoid_otp": {"a": {"target_regions": [["a_1", 0, 24]]}}}}
    got = protocol.run(peaks, targets, {"genome": records}).collect()
    assert sorted((r["target"], r["start"], r["on_target"]) for r in got if r["target"] == "a") == [("a", 1, 1), ("a", 13, 1)]
    assert len([r for r in got if r["target"] == "b"]) == 2


def test_protocol_refuses_what_it_cannot_do(spark):
    p = {"targets": [], "extracts": {"target_region": {"length": 8}}, "probes": {"probe": {"expr": "rc(target_region)"}}, "attributes": {"hits": {"type": "mapped_genes", "target": "target_region", "max_mismatches": 9, "oligos": ["x"]}}, "post_process": {"avoid_otp": {"t": {}}, "off_target_pool": {"attribute": "gc", "max_probes_per_gene": 1}}}
    text = " ".join(protocol.analyse(p))
    assert all(x in text for x in ("max_mismatches", "two layout parts", "avoid_otp", "off_target_pool"))


def test_final_numbers_and_modifications(spark):
    targets = spark.createDataFrame([("t", "ACGTTGCAGGATCCATTGCAAGTCACGTTGCC")], "target string, seq string")
    chemistry = {"5prime": {"type": "fluorophore", "name": "Cy5"}, "internal": [{"type": "disulfide", "after_base": 4}]}
    p = {"targets": [], "extracts": {"target_region": {"length": 8}}, "probes": {"turn": {"expr": "'ACGT'[probe_index % 4]"}, "probe": {"expr": "rc(target_region) + turn", "modifications": chemistry}, "plain": {"expr": "rc(target_region)"}}, "attributes": {"g": {"type": "base_fraction", "target": "turn", "bases": "G"}}, "post_process": {"remove_overlap": {}, "sorts": {"is_descending": ["start"]}}}
    assert protocol.reads(p["probes"], "probe_index") == {"turn", "probe"}
    got = protocol.run(p, targets).collect()
    assert [(r["start"], r["probe_index"], r["final_index"], r["turn"], r["g"]) for r in got] == [(25, 3, 0, "T", 0), (17, 2, 1, "G", 1), (9, 1, 2, "C", 0), (1, 0, 3, "A", 0)]
    assert all(r["probe"] == r["plain"] + r["turn"] for r in got)
    assert [(m["position"], m["type"], m["name"], m["after_base"]) for m in got[0]["probe__modifications"]] == [("5prime", "fluorophore", "Cy5", None), ("internal", "disulfide", None, 4)]
    for bad, word in (({"middle": "phosphate"}, "unknown position"), ({"5prime": "disulfide"}, "does not go here"), ({"internal": [{"type": "disulfide", "after_base": 0}]}, "after_base"), ({"internal": [{"type": "disulfide", "after_base": 2}] * 2}, "taken"), ({"3prime": {"type": "phosphate", "name": "x"}}, "name"), ({"3prime": {"type": "phosphate", "colour": "x"}}, "unknown field"), ("x", "must map")):
        assert any(word in x for x in protocol.analyse(p | {"probes": p["probes"] | {"probe": {"expr": "turn", "modifications": bad}}})), bad
    nested = {"probe": {"template": "{a}", "parts": {"a": {"expr": "turn", "modifications": {"5prime": "phosphate"}}}}}
    assert any("only probes" in x for x in protocol.analyse(p | {"probes": p["probes"] | nested}))
    short = p["probes"] | {"probe": {"expr": "turn", "modifications": chemistry}}
    with pytest.raises(Exception, match="needs 5 bases"):
        protocol.run(p | {"probes": short}, targets).collect()


def test_dry_run_column_order_and_windows(spark):
    p = {"targets": [], "extracts": {"target_region": {"length": [6, 8], "layout": {"parts": {"l": {"length": [3, 4]}, "r": {"length": [3, 4]}}}}}, "probes": {"a": {"expr": "target_parts.l[0:2]"}, "b": {"expr": "target_region[7]"}}}
    got = {r["probe"]: r for r in protocol.dry_run(spark, p, ["x", "y"]).collect()}
    assert (got["a"]["n_empty"], got["a"]["shortest"], got["a"]["longest"]) == (0, 2, 2)
    assert 0 < got["b"]["n_empty"] < got["b"]["n"] == got["a"]["n"]
    p["attributes"] = {"gc": {"target": "a", "type": "gc_content"}, "hits": {"target": "target_region", "type": "mapped_genes"}}
    columns = ["hits_off_targets", "a", "gc", "target", "b", "hits", "target_parts__l", "target_region", "start"]
    assert finishing.ordered_columns(columns, p) == ["target", "start", "target_region", "hits", "hits_off_targets", "target_parts__l", "a", "gc", "b"]
    table = finishing.result_table(spark.createDataFrame([("x", 1, "['t1', 't2']")], "target string, start int, transcript_names string"), p)
    assert table.columns == ["target", "transcript_names"] and table.first()[1] == "t1; t2"
    window = lambda ours, own: finishing.temperature_window({"hybridization": ours, "attributes": {"tm": {"hybridization": own}}}, "tm", protocol.CONDITIONS)
    assert window({}, {}) == (50, 90, None)
    assert window({"temperature_c": 42}, {}) == (42, 82, "protocol")
    assert window({"temperature_c": 42}, {"temperature_c": 47}) == (47, 87, "attribute")
    assert window({"temperature_c": 42, "na_mM": 300}, {"na_mM": 390}) == (50, 90, None)
    assert window({"temperature_c": 42, "na_mM": 300}, {"na_mM": 300}) == (42, 82, "protocol")
    assert window({"na_mM": 300}, {}) == (37, 77, "default")
    base = {"probes": {"probe": "x"}, "hybridization": {"temperature_c": 47}}
    assert protocol.with_defaults(base, temperature=True)["post_process"]["filters"]["probe_tm"] == {"condition": "probe_tm >= 47 & probe_tm <= 87"}
    assert [finishing.file_stem(x) for x in ("a b/c", "..", ".x-1.2")] == ["a_b_c", "probes", "x-1.2"]


def test_steps_rows_and_barcodes(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([("ACGT", 1), ("TTGA", 2)], "sequence string, n int")
    again = writers.write_step(df, str(tmp_path), "candidates")
    assert sorted(map(tuple, again.collect())) == [("ACGT", 1), ("TTGA", 2)] == sorted(map(tuple, readers.read_step(spark, str(tmp_path / "candidates")).collect()))
    writers.write_barcodes(df, str(tmp_path), "set")
    assert sorted(r[0] for r in readers.read_rows(spark, str(tmp_path / "set.csv")).collect()) == ["ACGT", "TTGA"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "set.txt")).collect()) == ["ACGT", "TTGA"]
    with gzip.open(tmp_path / "rows.csv.gz", "wt", encoding="utf-8-sig") as f:
        f.write('gene,"seq"\nA,"AC,""GT"\nB,\n')
    got = readers.read_step(spark, str(tmp_path / "rows.csv.gz"))
    assert got.columns == ["gene", "seq"] and list(map(tuple, got.collect())) == [("A", 'AC,"GT'), ("B", None)]
    (tmp_path / "codes.csv").write_text("b1,ACGT\nb2,AAAA\nlonely\nb3,A,C\nb1,TTTT\n")
    assert sorted(map(tuple, readers.barcode_table(spark, str(tmp_path / "codes.csv")).collect())) == [("b1", "TTTT"), ("b2", "AAAA")]
