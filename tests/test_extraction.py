"""The source stage against a plain reading of annotation and contigs."""

import random

import pytest

from tilewright.plans import extraction, protocol
from tilewright.sources import readers

FLIP = str.maketrans("ACGT", "TGCA")
EXONS = {  # gene: strand, {transcript: (tags, exons, cds, utrs)}
    "a": ("+", {"a1.2": (["MANE_Select", "Ensembl_canonical"], [(11, 30), (51, 58), (81, 120)], [(21, 30), (51, 58), (81, 100)], [(11, 20), (101, 120)]), "a2.1": ([], [(11, 30), (81, 140)], [], [])}),
    "b": ("-", {"b1.1": (["Ensembl_canonical"], [(201, 230), (241, 260)], [], []), "b2.1": (["Ensembl_canonical"], [(206, 260)], [], []), "b3.1": ([], [(301, 304)], [], [])}),
    "c": ("-", {"c1": (["Ensembl_canonical"], [(401, 430), (441, 460)], [(411, 430)], [(431, 430), (441, 460)])}),
}


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(7)
    seq = "".join(r.choices("ACGT", k=600))
    seq = seq[:520] + seq[520:530].lower() + "N" + seq[531:]
    rows = []
    for gene, (strand, transcripts) in EXONS.items():
        for name, (tags, exons, cds, utrs) in transcripts.items():
            for kind, places in (("exon", exons), ("CDS", cds), ("three_prime_utr", utrs)):
                rows += [("7", kind, a, b, strand, gene, name, tags) for a, b in places if b >= a]
    annotation = spark.createDataFrame(rows, "chr string, type string, start long, end long, strand string, gene_name string, transcript_id string, tags array<string>")
    contigs = spark.createDataFrame([("chr7", seq), ("8", "ACGT" * 9)], "name string, seq string")
    return seq.upper(), {"annotation": annotation, "contigs": contigs, "mask": spark.createDataFrame([("chr7", 480, 483)], "chrom string, start0 long, end0 long")}


def read(seq, a, b, strand):
    s = seq[a - 1 : b]
    return s.translate(FLIP)[::-1] if strand == "-" else s


def got(spark, world, targets, **region):
    p = {"extracts": {"target_region": region}}
    w = extraction.windows(p, spark.createDataFrame([(t,) for t in targets], "target string"), world[1])
    return sorted(w.collect(), key=lambda r: (r.target, int(r.probe_id.split("_")[-1])))


def spliced(seq, gene, places, strand, low, high, step):
    places = sorted(places, reverse=strand == "-")
    whole = "".join(read(seq, a, b, strand) for a, b in places)
    ends, out = [], []
    for a, b in places:
        ends.append((ends[-1] if ends else 0) + b - a + 1)
    for i in range(0, len(whole), step):
        for n in range(low, high + 1):
            if i + n <= len(whole):
                on = [k for k, e in enumerate(ends) if (ends[k - 1] if k else 0) < i + n and e > i]
                start = i + 1 - (ends[on[0] - 1] if on[0] else 0)
                name = ";".join(f"7_{places[k][0]}_{places[k][1]}_{strand}" for k in on)
                out.append((gene, f"{start}_{start + n - 1}", name, start, start + n - 1, i + 1, i + n, whole[i : i + n], 1))
    return out


FIELDS = ("target", "sub_region", "exon_name", "start", "end", "target_start", "target_end", "target_region", "n_trans")


@pytest.mark.parametrize(("source", "low", "high", "step"), [("mRNA", 12, 12, 1), ("CDS", 7, 9, 3), ("exon", 7, 7, 2)])
def test_one_transcript_is_spliced(spark, world, source, low, high, step):
    rows = got(spark, world, ["a", "c"], source=source, transcripts="mane", length=[low, high], step=step)
    places = {"a": EXONS["a"][1]["a1.2"], "c": EXONS["c"][1]["c1"]}
    want = [x for g in "ac" for x in spliced(world[0], g, places[g][1 if source == "mRNA" else 2], EXONS[g][0], low, high, step)]
    assert [tuple(r[c] for c in FIELDS) for r in rows] == want
    assert {tuple(r.transcript_names) for r in rows} == {("a1.2",), ("c1",)}


def segment_windows(seq, gene, strand, named, low):
    """Windows of each distinct segment with places on the union of all."""
    blocks = []
    for a, b in sorted(named):
        if blocks and a <= blocks[-1][1]:
            blocks[-1][1] = max(b, blocks[-1][1])
        else:
            blocks.append([a, b])
    model = [x for a, b in blocks for x in range(a, b + 1)]
    model = model[::-1] if strand == "-" else model
    out = []
    for (a, b), names in sorted(named.items()):
        s = read(seq, a, b, strand)
        offset = model.index(b if strand == "-" else a)
        out += [(gene, f"{i + 1}_{i + low}", f"7_{a}_{b}_{strand}", i + 1, i + low, offset + i + 1, offset + i + low, s[i : i + low], len(names)) for i in range(len(s) - low + 1)]
    return out


@pytest.mark.parametrize(("source", "low"), [("mRNA", 10), ("CDS", 9)])
def test_segments_of_several_transcripts(spark, world, source, low):
    """All transcripts: segments once, with places on the merged model; short ones count there for mRNA only."""
    rows = got(spark, world, ["a", "b"], source=source, transcripts="all", length=low)
    want = []
    for gene in "ab":
        strand, transcripts = EXONS[gene]
        coding = source == "CDS" and any(x[2] for x in transcripts.values())
        named = {}
        for name, x in transcripts.items():
            for place in x[2] if coding else x[1]:
                if source == "mRNA" or place[1] - place[0] + 1 >= low:
                    named.setdefault(place, set()).add(name)
        want += segment_windows(world[0], gene, strand, named, low)
    assert [tuple(r[c] for c in FIELDS) for r in rows] == want


def test_rules_choose_transcripts(spark, world):
    """Two canonical transcripts: both, by segment; a list names versions or not; what no rule chooses is an error."""
    rows = got(spark, world, ["b", "a"], source="mRNA", transcripts="canonical", length=20)
    assert {(r.target, tuple(r.transcript_names)) for r in rows} == {("a", ("a1.2",)), ("b", ("b1.1",)), ("b", ("b2.1",))}
    rows = got(spark, world, ["b", "a"], source="mRNA", transcripts=["a2", "b1.1", "b2.1"], length=20)
    assert {(r.target, tuple(r.transcript_names)) for r in rows} == {("a", ("a2.1",)), ("b", ("b1.1",)), ("b", ("b2.1",))}
    with pytest.raises(ValueError, match="without one: b"):
        got(spark, world, ["a", "b"], source="mRNA", transcripts=["a1.2"], length=20)
    with pytest.raises(ValueError, match="lacks: x"):
        got(spark, world, ["a", "x"], source="mRNA", length=20)


def test_untranslated_segments(spark, world):
    rows = got(spark, world, ["a", "c"], source="UTR", length=8)
    assert {(r.target, r.utr_name) for r in rows} == {("a", "a_11_20"), ("a", "a_101_120"), ("c", "c_441_460")}
    assert all(r.target_region == read(world[0], *((int(r.utr_name.split("_")[1]) + r.start - 1, int(r.utr_name.split("_")[1]) + r.end - 1)), "+") for r in rows if r.target == "a")
    assert [r.target_start for r in rows if r.utr_name == "a_101_120"][0] == 11


@pytest.mark.parametrize("masked", ["keep", "drop"])
def test_regions_without_masked_bases(spark, world, masked):
    """Lower case, N and the mask's bases; what is left keeps its number."""
    rows = got(spark, world, ["chr7:471-560"], source="genome", length=[8, 9], step=2, masked=masked)
    bad = set(range(481, 484)) | set(range(521, 532))
    want, n = [], 0
    for i in range(0, 90, 2):
        for k in (8, 9):
            if i + k <= 90:
                n += 1
                if masked == "keep" or not bad & set(range(471 + i, 471 + i + k)):
                    want.append((f"chr7:471-560_{n}", f"{i + 1}-{i + k}", world[0][470 + i : 470 + i + k]))
    assert [(r.probe_id, r.sub_region, r.target_region) for r in rows] == want
    with pytest.raises(ValueError, match="no regions"):
        got(spark, world, ["chr7"], source="genome", length=8)


def test_regions_come_from_chunks(spark):
    r = random.Random(1)
    seq = "".join(r.choices("ACGT", k=1000))
    places = [(a, min(1000, a + r.randint(0, 300)), r.choice("+-")) for a in r.sample(range(1, 1000), 60)]
    regions = spark.createDataFrame([("chr1", *x) for x in places] + [("2", 1, 5, "+"), ("chr1", 1001, 1010, "+")], "chr string, a long, b long, strand string")
    out = readers.region_sequence(regions, spark.createDataFrame([("1", seq)], "name string, seq string"), "chr", "a", "b", "strand", size=64).collect()
    assert len(out) == 62 and all(x.seq == (read(seq, x.a, x.b, x.strand) if x.chr == "chr1" and x.a <= 1000 else None) for x in out)


def test_oligos_with_several_sites_are_one(spark):
    """A window that stands twice is kept once with both sites, which it occupies; even spacing counts it once."""
    seq = "ACGTTGCAGG" + "TTTCCCAAAG" + "ACGTTGCAGG" + "CATCATGGTA"
    p = {"targets": [], "extracts": {"target_region": {"length": 10, "step": 5}}, "probes": {"probe": {"expr": "rc(target_region)"}}, "post_process": {"remove_overlap": {"location_interval": 0}}}
    targets = spark.createDataFrame([("t", seq)], "target string, seq string")
    out = sorted((r.start, r.n_sites, r.oligo_sites) for r in protocol.run(p, targets).collect())
    assert out == [(1, 2, "1-10;21-30"), (11, 1, "11-20"), (31, 1, "31-40")]
    spaced = p | {"post_process": {"equal_space": {"number_desired": 9, "t": {"number_desired": 2}}}}
    assert sorted(r.start for r in protocol.run(spaced, targets).collect()) == [1, 31]


def test_keys_that_nothing_reads_are_refused():
    p = {"targets": [], "extracts": {"target_region": {"length": 8, "strep": 2, "source": "mRNA"}}, "probes": {"probe": {"expr": "rc(target_parts['left'])"}}, "attributes": {"g": {"type": "gc_content", "target": "probe", "window": 3}}, "post_process": {"remove_overlaps": {}}, "gene_expression": {"level": "transcript"}}
    text = "\n".join(protocol.analyse(p))
    for part in ("strep: unknown key; did you mean 'step'?", "attributes.g.window", "post_process.remove_overlaps", "gene_expression.level", "unknown name 'target_parts.left'"):
        assert part in text
    assert "transcripts" in " ".join(extraction.problems({"length": 8, "source": "genome", "transcripts": "mane"})) and extraction.problems({"length": 8, "overlap": 8})
