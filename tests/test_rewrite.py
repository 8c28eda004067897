"""The rewrite pass: what it prunes, what it adds, and that it changes nothing the second time."""

from copy import deepcopy

import pytest

from tilewright.catalog.templates import DESIGNS
from tilewright.plans import protocol, rewrite

PADLOCK = {"padlock": {"template": "{left}{mid}", "parts": {"left": {"expr": "rc(target_region[0:10])"}, "mid": {"template": "{part1}A", "parts": {"part1": {"expr": "'ACGT'"}}}}}, "plain": "rc(target_region)"}


def base(source="mRNA", **more):
    region = {"source": source, "length": 20} if source else {"length": 20}
    return {"targets": ["a"], "extracts": {"target_region": region}, "probes": deepcopy(PADLOCK)} | more


@pytest.mark.parametrize("name", sorted(DESIGNS))
def test_published_designs(name):
    """Written blocks stay as they are; a second pass finds nothing; without blocks, sound ones are made."""
    given = deepcopy(DESIGNS[name])
    assert rewrite.pruned(given) == given
    once, changes = rewrite.rewritten(given, rewrite.ALL)
    assert given == DESIGNS[name] and {c.rule for c in changes} <= {"summary", "step of windows"}
    assert all(once[k] == given[k] for k in ("attributes", "post_process", "probes")) and rewrite.rewritten(once, rewrite.ALL) == (once, [])
    bare = {k: v for k, v in given.items() if k not in ("attributes", "post_process", "summary")}
    made, changes = rewrite.rewritten(bare, rewrite.ALL)
    assert {c.rule for c in changes} >= {"attributes", "post-processing", "summary"} and rewrite.normalised(made) == made
    assert all("37 degrees only" in x for x in protocol.analyse(made))  # energies in another reaction are refused by name


def test_blank_steps_and_steps_of_the_genome():
    post = {"filters": {}, "sorts": None, "remove_overlap": {"location_interval": None, "prefer": ""}, "off_target_pool": [], "equal_space": {"number_desired": 0}, "avoid_otp": {"a": {"x": 1}}}
    assert rewrite.pruned(base(post_process=post))["post_process"] == {"equal_space": {"number_desired": 0}}
    for source in ("genome", None):
        assert rewrite.pruned(base(source, post_process=post))["post_process"] == {"equal_space": {"number_desired": 0}, "avoid_otp": {"a": {"x": 1}}}
    p = base(post_process=post)
    places = [(c.rule, c.place) for c in rewrite.rewritten(p, rewrite.PRUNING)[1]]
    assert ("steps of the genome only", "post_process.avoid_otp") in places and ("blank steps", "post_process.remove_overlap") in places
    assert len(places) == 5 and p == base(post_process=post)


def test_made_for_transcripts():
    p = rewrite.normalised(base(hybridization={"temperature_c": 45}, post_process={"filters": None}))
    assert list(p["attributes"])[:6] == ["target_gc", "target_tm", "target_fold", "target_self_match", "target_mapped_genes", "padlock_gc"]
    assert p["attributes"]["padlock_mid_part1_tm"] == {"target": "padlock.mid.part1", "type": "annealing_temperature"} and len(p["attributes"]) == 5 + 5 * 4
    filters = {k: v["condition"] for k, v in p["post_process"]["filters"].items()}
    assert filters["target_gc"] == "target_gc >= 0.2 & target_gc <= 0.8" and filters["target_mapped_genes"] == "target_mapped_genes <= 4"
    assert filters["padlock_left_tm"] == "padlock_left_tm >= 45 & padlock_left_tm <= 85" and "plain_gc" in filters and "padlock_left_gc" not in filters
    up = p["post_process"]["sorts"]["is_ascending"]
    assert up[:3] == ["target_gc", "target_tm", "target_mapped_genes"] and up.index("plain_tm") < up.index("target_fold")
    assert p["summary"]["report_name"] == "rna_report" and "plain_fold" in p["summary"]["attributes"] and "padlock_mid_part1_tm" in p["summary"]["attributes"] and "padlock_mid_part1_gc" not in p["summary"]["attributes"]
    assert p["extracts"]["target_region"]["step"] == 1


def test_made_for_the_genome():
    p = rewrite.normalised(base("genome") | {"extracts": {"target_region": {"source": "genome", "length": 20, "overlap": 15}}})
    assert p["extracts"]["target_region"] == {"source": "genome", "length": 20, "step": 5}
    assert "target_gc" not in p["attributes"] and "plain_gc" not in p["attributes"] and p["attributes"]["padlock_left_mapped_sites"]["aligner"] == "bowtie2"
    assert p["post_process"]["filters"]["target_kmer_count"] == {"condition": "target_kmer_count <= 100"} and "padlock_left_kmer_count" not in p["post_process"]["filters"]
    assert p["summary"] == {"report_name": "dna_report", "attributes": ["target_kmer_count", "padlock_mid_part1_gc", "padlock_mid_part1_tm", "padlock_mid_part1_kmer_count"]}


def test_own_attributes_get_filters():
    p = rewrite.normalised(base(attributes={"plain_tm": {"target": "plain", "type": "annealing_temperature"}, "target_other_gc": {"target": "target_region", "type": "gc_content"}}))
    assert set(p["post_process"]["filters"]) == {"plain_tm"} and p["post_process"]["sorts"]["is_ascending"] == ["plain_tm", "target_other_gc"]


def test_run_of_a_pruned_protocol(spark):
    p = {"targets": [], "extracts": {"target_region": {"length": 8}}, "probes": {"probe": {"expr": "rc(target_region)"}}, "post_process": {"remove_overlap": {"location_interval": None}, "filters": {}, "equal_space": {}}}
    got = protocol.run(rewrite.pruned(p), spark.createDataFrame([("a", "ACGTACGTAC")], "target string, seq string"))
    assert sorted(x.start for x in got.collect()) == [1, 2, 3]
