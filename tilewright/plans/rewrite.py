"""Rewriting a protocol before it is planned: rules that prune, spell out and complete, applied to a fixed point."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass
from itertools import chain

from . import extraction, finishing

# --- what is made where a protocol says nothing; fixed values

GC, TM, FOLD, SELF = {"type": "gc_content"}, {"type": "annealing_temperature"}, {"type": "fold_score"}, {"type": "self_match"}
GENES = {"type": "mapped_genes", "aligner": "bowtie", "max_mismatches": 2, "strand": "sense"}
KMERS = {"type": "kmer_count", "kmer_len": 35, "size": "1G", "aligner": "jellyfish"}
SITES = {"type": "mapped_sites", "aligner": "bowtie2"}
STRUCTURE = {"gc": GC, "tm": TM, "fold": FOLD, "self_match": SELF}

#: By mode and kind of sequence, the attributes that are made for it.
ATTRIBUTES = {
    ("rna", "window"): STRUCTURE | {"mapped_genes": GENES},
    ("rna", "probe"): STRUCTURE,
    ("rna", "part"): STRUCTURE,
    ("dna", "window"): {"kmer_count": KMERS},
    ("dna", "probe"): {},
    ("dna", "part"): STRUCTURE | {"mapped_sites": SITES, "kmer_count": KMERS},
}
#: By mode, kind and suffix of an attribute, the bounds that a filter made for it keeps; TM stands for the reaction's window.
SHARE = (0.2, 0.8)
FILTERS = {(m, k, s): b for m in ("rna", "dna") for k, s, b in (("window", "gc", SHARE), ("window", "tm", TM), ("probe", "gc", SHARE), ("probe", "tm", TM), ("part", "tm", TM))}
FILTERS |= {("dna", "window", "kmer_count"): (None, 100), ("rna", "window", "mapped_genes"): (None, 4)}
#: Suffixes in order of rank; all sort upwards.
RANKS = (("gc", "tm", "mapped_genes"), ("fold", "self_match", "kmer_count"))
#: By mode and kind of name, the suffixes that a report shows.
SHOWN = {
    ("rna", "window"): ("gc", "tm", "fold", "self_match", "mapped_genes"), ("rna", "probe"): ("gc", "tm", "fold"), ("rna", "part"): ("tm",),
    ("dna", "window"): ("kmer_count",), ("dna", "probe"): (), ("dna", "part"): ("gc", "tm", "kmer_count"),
}
#: Steps that only designs on the genome have.
GENOME_STEPS = ("avoid_otp",)


@dataclass(frozen=True)
class Change:
    """What a rule did, and where."""

    rule: str
    place: str


def mode(protocol: dict) -> str:
    """``dna`` where windows come from the genome, which is what no source means beside contigs; else ``rna``."""
    return "dna" if _region(protocol).get("source", "genome") == "genome" else "rna"


def _region(protocol: dict) -> dict:
    return (protocol.get("extracts") or {}).get("target_region") or {}


def _places(probes: dict) -> Iterator[tuple[str, str]]:
    """(name, kind) of all probes and their parts, each before its own parts."""
    stack = [(str(name), "probe", spec) for name, spec in reversed(probes.items())]
    while stack:
        name, kind, spec = stack.pop()
        yield name, kind
        parts = (spec.get("parts") or {}) if isinstance(spec, dict) else {}
        stack += [(f"{name}.{k}", "part", v) for k, v in reversed(parts.items())]


def _suffix(name: str) -> str | None:
    known = {s for made in ATTRIBUTES.values() for s in made}
    return next((s for s in sorted(known, key=len, reverse=True) if name.endswith(f"_{s}")), None)


def _kind(name: str, attribute: dict) -> str:
    return "window" if name.startswith("target_") else "part" if "." in str(attribute.get("target")) else "probe"


def is_blank(value: object) -> bool:
    """A placeholder: nothing, or a block whose every option is nothing."""
    if isinstance(value, dict):
        return all(v is None or v == "" for v in value.values())
    return value is None or value == []


# --- rules: each gives the places that it would change, and changes them in its own copy


def _blank_steps(p: dict) -> list[str]:
    post = p.get("post_process")
    blank = [k for k, v in post.items() if is_blank(v)] if isinstance(post, dict) else []
    for k in blank:
        del post[k]
    return [f"post_process.{k}" for k in blank]


def _genome_steps(p: dict) -> list[str]:
    post = p.get("post_process")
    found = [k for k in GENOME_STEPS if k in post] if isinstance(post, dict) and mode(p) == "rna" else []
    for k in found:
        del post[k]
    return [f"post_process.{k}" for k in found]


def _step_of_windows(p: dict) -> list[str]:
    region = _region(p)
    if "length" not in region or ("overlap" not in region and region.get("step") is not None):
        return []
    if region.get("step") is None:
        region["step"] = extraction.step_of({k: v for k, v in region.items() if k != "step"})
    region.pop("overlap", None)
    return ["extracts.target_region.step"]


def _attributes(p: dict) -> list[str]:
    if p.get("attributes") or not p.get("probes"):
        return []
    m = mode(p)
    made = {f"{label}_{s}": {"target": target} | spec for target, label, kind in chain([("target_region", "target", "window")], ((n, n.replace(".", "_"), k) for n, k in _places(p["probes"]))) for s, spec in ATTRIBUTES[m, kind].items()}
    p["attributes"] = made
    return [f"attributes.{k}" for k in made]


def _number(x: float) -> str:
    return f"{x:f}".rstrip("0").rstrip(".")


def _condition(p: dict, name: str, bounds: object) -> str:
    low, high = finishing.temperature_window(p, name, finishing.CONDITIONS)[:2] if bounds is TM else bounds
    return " & ".join(f"{name} {sign} {_number(x)}" for sign, x in ((">=", low), ("<=", high)) if x is not None)


def _post_process(p: dict) -> list[str]:
    if p.get("post_process") or not p.get("attributes"):
        return []
    ends = {name: _suffix(name) for name in p["attributes"]}
    kept = {name: FILTERS.get((mode(p), _kind(name, a), ends[name])) for name, a in p["attributes"].items() if not name.startswith("target_") or name == f"target_{ends[name]}"}
    p["post_process"] = {
        "filters": {name: {"condition": _condition(p, name, b)} for name, b in kept.items() if b is not None},
        "sorts": {"is_ascending": [name for rank in RANKS for name, s in ends.items() if s in rank], "is_descending": []},
    }
    return [f"post_process.{k}" for k in p["post_process"]]


def _summary(p: dict) -> list[str]:
    if p.get("summary") or not p.get("attributes"):
        return []
    m = mode(p)
    kind = lambda name: "window" if name.startswith("target_") else "part" if "_part" in name else "probe"
    p["summary"] = {"report_name": f"{m}_report", "attributes": [n for n in p["attributes"] if _suffix(n) in SHOWN[m, kind(n)]]}
    return ["summary"]


Rule = Callable[[dict], list[str]]
PRUNING: dict[str, Rule] = {"blank steps": _blank_steps, "steps of the genome only": _genome_steps}
ALL: dict[str, Rule] = PRUNING | {"step of windows": _step_of_windows, "attributes": _attributes, "post-processing": _post_process, "summary": _summary}


def rewritten(protocol: dict, rules: dict[str, Rule]) -> tuple[dict, list[Change]]:
    """(protocol, changes): the rules over a copy, again and again until none changes a thing.

    Each rule removes a key or fills one that is empty, and none empties what another fills, so this ends.
    """
    p, changes = deepcopy(protocol), []
    while now := [Change(name, place) for name, rule in rules.items() for place in rule(p)]:
        changes += now
    return p, changes


def pruned(protocol: dict) -> dict:
    """The protocol without steps that are placeholders or have no meaning in its mode; nothing is added."""
    return rewritten(protocol, PRUNING)[0]


def normalised(protocol: dict) -> dict:
    """The protocol pruned, with its step spelled out and attributes, filters, order and summary where it has none.

    Conditions of temperatures follow the reaction that the protocol declares (``finishing.temperature_window``). Searches
    among the made attributes need their tables in a run, as those that are written; the made folding scores are refused by
    ``protocol.analyse`` where the reaction is not at 37 degrees.
    """
    return rewritten(protocol, ALL)[0]
