"""Protocols: a declarative description of a design, analysed and compiled to one lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from string import Formatter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import folding, thermo
from ..functions import sequence as S
from ..operators import selection, summary
from ..operators.windows import expand_layouts, number_within
from ..session import kept
from . import extraction, finishing, similarity
from .expression import ExpressionError, Typed, compile_expression, problems, references

REQUIRED = ("targets", "extracts", "probes")


def load(path: str) -> dict:
    """A protocol file; keys that stand twice are an error."""
    import yaml

    class Once(yaml.SafeLoader):
        pass

    def mapping(loader: Any, node: Any) -> dict:
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len(keys) != len(set(map(str, keys))):
            raise ValueError(f"a key stands twice: {node.start_mark}")
        return {loader.construct_object(k): loader.construct_object(v, deep=True) for k, v in node.value}

    Once.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(Path(path).read_text(), Once)  # noqa: S506


@dataclass
class Node:
    """A probe or a part: an expression, or a template over its parts."""

    name: str
    expr: str | None = None
    template: str | None = None
    parts: dict[str, Node] = field(default_factory=dict)


def nodes(probes: dict) -> dict[str, Node]:
    """All probes and dotted parts by name."""
    out: dict[str, Node] = {}

    def add(name: str, spec: Any) -> Node:
        spec = {"expr": spec} if isinstance(spec, str) else spec
        n = Node(name, spec.get("expr"), spec.get("template"))
        for k, v in (spec.get("parts") or {}).items():
            n.parts[k] = add(f"{name}.{k}", v)
        out[name] = n
        return n

    for k, v in probes.items():
        add(k, v)
    return out


def needs(n: Node) -> list[str]:
    if n.expr is not None:
        return references(n.expr)
    return [f"{n.name}.{x}" if x in n.parts else x for _, x, _, _ in Formatter().parse(n.template or "") if x]


def ordered(all_nodes: dict[str, Node]) -> list[str]:
    """Names so that each follows what it needs; ValueError names the members of a cycle."""
    waiting = {k: {x for x in map(lambda r: _resolve(r, k, all_nodes), needs(n)) if x} for k, n in all_nodes.items()}
    out: list[str] = []
    while waiting:
        free = [k for k, v in waiting.items() if not v]
        if not free:
            raise ValueError("these need each other: " + ", ".join(sorted(waiting)))
        out += free
        waiting = {k: v - set(free) for k, v in waiting.items() if k not in free}
    return out


def _resolve(name: str, at: str, all_nodes: dict[str, Node]) -> str | None:
    """A reference's node: as it stands, or next to where it is read."""
    near = f"{at.rpartition('.')[0]}.{name}" if "." in at else name
    return near if near in all_nodes and near != at else name if name in all_nodes and name != at else None


def template_column(template: str, scope: dict[str, Typed]) -> Column:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(scope[name].column)
    return F.concat(*parts) if parts else F.lit("")


def reads(probes: dict, name: str) -> set[str]:
    """The probes and parts whose sequence depends on a name, directly or through others. Those that fail to parse do not."""
    all_nodes = nodes(probes)
    direct = {}
    for k, n in all_nodes.items():
        try:
            direct[k] = {_resolve(r, k, all_nodes) or r for r in needs(n)}
        except ExpressionError:
            direct[k] = set()
    found: set[str] = set()
    while more := {k for k, v in direct.items() if k not in found and v & (found | {name})}:
        found |= more
    return found


def construct(df: DataFrame, probes: dict, encoding: dict | None = None, scope: dict[str, Typed] | None = None, only: set[str] | None = None) -> DataFrame:
    """``df`` with a column for each probe and part (dots as ``__``). A node that fails for a row is the empty text there.

    With ``only``, just these are built, and the others' columns are read.
    """
    base = scope or {c: Typed(F.col(c), "number" if t in ("int", "bigint") else "text") for c, t in df.dtypes if t in ("string", "int", "bigint")}
    all_nodes = nodes(probes)
    done: dict[str, Typed] = {}
    for name in ordered(all_nodes):
        n = all_nodes[name]
        if only is not None and name not in only:
            done[name] = Typed(F.col(name.replace(".", "__")), "text")
            continue
        known = dict(base)
        for r in needs(n):
            if (at := _resolve(r, name, all_nodes)) is not None:
                known[r] = done[at]
                known[r.removeprefix(name + ".")] = done[at]
        if n.expr is not None:
            c = compile_expression(n.expr, known, {"encoding": encoding or {}}).column
        else:
            c = template_column(n.template or "", known)
        col = name.replace(".", "__")
        df = df.withColumn(col, F.coalesce(c.cast("string"), F.lit("")))
        done[name] = Typed(F.col(col), "text")
    return df


#: Attribute types by name: f(column, options, conditions) -> column. New types are added here.
ATTRIBUTES = {
    "gc_content": lambda c, o, h: S.gc_content(c),
    "length": lambda c, o, h: F.length(c),
    "base_fraction": lambda c, o, h: S.base_fraction(c, o["bases"], tuple(o["positions"]) if o.get("positions") else None),
    "max_homopolymer": lambda c, o, h: S.max_homopolymer(c, o.get("bases", S.DNA), tuple(o["positions"]) if o.get("positions") else None),
    "max_window_count": lambda c, o, h: S.max_window_count(c, o["bases"], o["window"], tuple(o["positions"]) if o.get("positions") else None),
    "self_match": lambda c, o, h: S.self_match(c),
    "stem_score": lambda c, o, h: thermo.stem_score(c),
    "fold_score": lambda c, o, h: folding.fold_score(c),
    "blocks": lambda c, o, h: folding.blocks(c, o.get("offset", 0)),
    "rna_dna_dg37": lambda c, o, h: thermo.rna_dna_37(c, o.get("sequence") == "target"),
    "annealing_temperature": lambda c, o, h: _temperature(c, o.get("tm_method", "primer"), h),
}
CONDITIONS = finishing.CONDITIONS


def conditions(protocol: dict, attribute: dict) -> dict:
    """The attribute's own, else the protocol's, else the defaults."""
    return CONDITIONS | (protocol.get("hybridization") or {}) | finishing.own_conditions(attribute, CONDITIONS)


def _temperature(c: Column, method: str, h: dict) -> Column:
    if method == "multi_padlock_design":
        return thermo.tm_padlock(c, h["na_mM"], h["mg_mM"], h["probe_nM"], h["formamide_pct"])
    if method == "oligominer":
        return thermo.tm_miner(c, h["na_mM"], h["probe_nM"], h["formamide_pct"])
    if method == "merfish_design":
        return thermo.tm_merfish(c, h["na_mM"], h["probe_nM"])
    # percent by volume as moles a litre: density 1.133, molar mass 45.04
    return thermo.tm_primer(c, h["na_mM"], h["mg_mM"], h["dntp_mM"], h["probe_nM"], h["formamide_pct"] * 11.33 / 45.04)


def column_name(target: str) -> str:
    return target.replace(":", ".").replace(".", "__")


def add_attributes(df: DataFrame, protocol: dict) -> DataFrame:
    """All attributes that are expressions; those that need other tables follow on what the filters leave."""
    specs = protocol.get("attributes") or {}
    for name, a in specs.items():
        if a["type"] == "difference":
            if set(a["of"]) <= set(df.columns):
                df = df.withColumn(name, F.abs(F.col(a["of"][0]) - F.col(a["of"][1])))
        elif a["type"] in ATTRIBUTES and column_name(a["target"]) in df.columns:
            df = df.withColumn(name, F.nanvl(ATTRIBUTES[a["type"]](F.col(column_name(a["target"])), a, conditions(protocol, a)).cast("double"), F.lit(None).cast("double")))
    tms = [(n, a) for n, a in specs.items() if a["type"] == "annealing_temperature"]
    if len(tms) > 1:
        kinds = [(a.get("tm_method"), tuple(sorted(conditions(protocol, a).items()))) for _, a in tms]
        df = df.withColumn("tm_diff", thermo.tm_difference([F.col(n) for n, _ in tms], kinds))
    return df


def _pooled(df: DataFrame, column: str) -> DataFrame:
    """``df`` with an array of genes in ``column``, whose lists are text."""
    return df.withColumn(column, similarity.listed_genes(F.col(column))) if dict(df.dtypes)[column] == "string" else df


def avoid_peaks(df: DataFrame, config: dict, site_columns: list[str], group: str = "target") -> DataFrame:
    """The ``avoid_otp`` step: of each target in ``config`` the rows that ``selection.avoid_peaks`` keeps, with their
    on_target, off_target and target_ratio; rows of other targets stay. Sites are those of all ``mapped_sites`` attributes.
    """
    if not site_columns:
        raise ValueError("post_process.avoid_otp: needs an attribute of type mapped_sites")
    sites = F.flatten(F.array(*[F.coalesce(F.transform(c, lambda x: F.struct(x["record"].alias("name"), x["start0"].cast("long").alias("start"), x["end0"].cast("long").alias("end"))), F.array().cast("array<struct<name:string,start:bigint,end:bigint>>")) for c in site_columns]))
    kept = None
    for target, o in config.items():
        regions = [(str(target), str(n), int(a), int(b)) for n, a, b in o.get("target_regions", [])]
        table = df.sparkSession.createDataFrame(regions, f"`{group}` string, name string, start long, end long")
        low, high = o.get("search_range", (-1_000_000, 1_000_000))
        own = df.where(F.col(group) == str(target)).select(group, "row_id", sites.alias("sites")).where(F.size("sites") > 0)
        one = selection.avoid_peaks(own, group, table, float(o.get("density_thresh", 1e-4)), (int(low), int(high)), o.get("avoid_target_overlap", True)).withColumn("g_", F.lit(str(target)))
        kept = one if kept is None else kept.unionByName(one)
    if kept is None:
        return df
    mine = F.col(group).isin([str(t) for t in config])
    kept = kept.withColumnRenamed("row_id", "r_")
    return df.join(kept, F.col(group).eqNullSafe(F.col("g_")) & (F.col("row_id") == F.col("r_")), "left").where(F.col("g_").isNotNull() | ~F.coalesce(mine, F.lit(False))).drop("g_", "r_")


def bounds_of(df: DataFrame) -> tuple[str, str]:
    """The columns that place a window along its target."""
    return ("target_start", "target_end") if "target_start" in df.columns else ("start", "end")


def along_targets(df: DataFrame, options: dict, group: str, start: str, end: str) -> DataFrame:
    """The ``remove_overlap`` step: windows free of each other, an oligo with several sites as one; the transcripts of all
    windows of a site on the one that stays."""
    out = selection.remove_overlap_sites(df, [group], start, end, ["target_region"] if "target_region" in df.columns else ["row_id"], options.get("location_interval", 0), options.get("prefer"), report="target_region" in df.columns)
    if "transcript_names" not in df.columns or start != "target_start":
        return out
    names = df.groupBy(F.col(group).alias("t_"), F.col(start).alias("s_"), F.col(end).alias("e_")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("transcript_names")))).alias("all_"))
    out = out.join(names, (F.col(group) == F.col("t_")) & (F.col(start) == F.col("s_")) & (F.col(end) == F.col("e_")), "left")
    more = F.size("all_") > F.size("transcript_names")
    return out.withColumns({"n_trans": F.when(more, F.size("all_").cast("long")).otherwise(F.col("n_trans")), "transcript_names": F.when(more, F.col("all_")).otherwise(F.col("transcript_names"))}).drop("t_", "s_", "e_", "all_")


def _quota(df: DataFrame, group: str, options: dict) -> Column:
    """Probes to keep: a target's own entry (``name: {number_desired: n}``, or in a mapping), else ``number_desired`` for all."""
    every = options.get("number_desired")
    own = {k: v["number_desired"] for k, v in options.items() if isinstance(v, dict) and "number_desired" in v}
    return selection.quota(df, group, every if isinstance(every, dict) else own, None if isinstance(every, dict) else every)


def post_process(df: DataFrame, post: dict, group: str = "target", start: str | None = None, end: str | None = None, site_columns: list[str] = (), ordered: bool = True) -> DataFrame:
    """Filters, peaks, overlaps, pool, even spacing and order, in this order whatever the protocol's.

    Places are those along the target where there are any. A filter on a column that the table lacks is an error, never
    left out. Even spacing counts an oligo that stands several times in a target once. Without ``ordered`` the rows are
    the same, in no order.
    """
    if start is None or end is None:
        start, end = bounds_of(df)
    if post.get("filters"):
        df = selection.filter_table(df, post["filters"], strict=True)
    sorts = post.get("sorts") or {}
    up, down = sorts.get("is_ascending") or [], sorts.get("is_descending") or []
    if post.get("avoid_otp"):
        df = avoid_peaks(df, post["avoid_otp"], list(site_columns), group)
    if "remove_overlap" in post:
        df = along_targets(df, post["remove_overlap"] or {}, group, start, end)
    if "off_target_pool" in post:
        p = post["off_target_pool"]
        df = selection.off_target_pool(_pooled(df, f"{p['attribute']}_off_targets"), group, f"{p['attribute']}_off_targets", p["max_probes_per_gene"], up, down)
    if "equal_space" in post:
        if "target_region" in df.columns:
            df = selection.collapse_identical(df, [group], ["target_region"], start)
        df = selection.even_ranks(df, group, start, _quota(df, group, post["equal_space"]))
    return selection.sort_table(df, up, down) if ordered else df


def _filter_columns(f: dict) -> set[str]:
    if f.get("type") == "sequence_pattern":
        return {column_name(f["target"])}
    return {c for text in ([f["condition"]] if isinstance(f["condition"], str) else f["condition"]) for c, _, _ in selection.parse_condition(text)}


def _searched(df: DataFrame, protocol: dict, tables: dict[str, DataFrame], targets: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` after the filters on what it has, with the attributes that need other tables; and the columns of sites.

    The filters come first so that only candidates that pass them are searched for; they are asked once more later, which
    changes nothing.
    """
    specs = {k: a for k, a in (protocol.get("attributes") or {}).items() if a["type"] in similarity.TYPES}
    filters = (protocol.get("post_process") or {}).get("filters") or {}
    df = kept(selection.filter_table(df, {k: f for k, f in filters.items() if _filter_columns(f) <= set(df.columns)}, strict=True)) if specs else df
    for name, a in specs.items():
        df = similarity.add(df, name, a, column_name(a["target"]), tables, targets, protocol.get("gene_expression") or {})
    for name, a in (protocol.get("attributes") or {}).items():
        if a["type"] == "difference" and name not in df.columns:
            df = df.withColumn(name, F.abs(F.col(a["of"][0]) - F.col(a["of"][1])))
    return df, [k for k, a in specs.items() if a["type"] == "mapped_sites"]


def scope_of(df: DataFrame) -> dict[str, Typed]:
    """The names that expressions may read of a table of windows."""
    scope = {c: Typed(F.col(c), k) for c, k in (("target_region", "text"), ("target", "text"), ("probe_index", "number")) if c in df.columns}
    return scope | {c.replace("__", "."): Typed(F.col(c), "text") for c in df.columns if c.startswith("target_parts__")}


def candidates(protocol: dict, targets: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The numbered windows of targets, from their source (see ``extraction``), with their layouts and probes, row by row."""
    region = protocol["extracts"]["target_region"]
    w = extraction.windows(protocol, targets, tables or {})
    if "layout" in region:
        low, high = extraction.lengths(region)
        bounds = {k: (v["length"], v["length"]) if isinstance(v["length"], int) else tuple(v["length"]) for k, v in region["layout"]["parts"].items()}
        w = expand_layouts(w, "target_region", bounds, low, high)
        w = w.withColumnsRenamed({f"{k}_seq": f"target_parts__{k}" for k in bounds})
    order = ["segment", "start0", "size", *(["layout"] if "layout" in w.columns else [])]
    w = number_within(w, ["target"], order, "probe_index").withColumn("row_id", F.col("probe_index").cast("long"))
    return construct(w, protocol["probes"], protocol.get("encoding"), scope_of(w))


def renumbered(df: DataFrame, protocol: dict, order: list[Column], tables: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """The final rows with probe_index 0, 1, ... along each target, and what depends on it made again.

    Filters and order saw the candidates' numbers. Only the probes, parts and attributes that read probe_index, directly
    or through others, change; a protocol without any keeps its numbers.
    """
    nodes_ = reads(protocol["probes"], "probe_index")
    if not nodes_:
        return df
    df = df.withColumn("probe_index", F.row_number().over(Window.partitionBy("target").orderBy(bounds_of(df)[0], *order)) - 1)
    df = construct(df, protocol["probes"], protocol.get("encoding"), scope_of(df), nodes_)
    mine = {k: a for k, a in (protocol.get("attributes") or {}).items() if str(a.get("target", "")).replace(":", ".") in nodes_}
    df = add_attributes(df, protocol | {"attributes": mine})
    for name, a in mine.items():
        if a["type"] in similarity.TYPES:
            df = similarity.add(df.drop(*similarity.columns(name, a["type"])), name, a, column_name(a["target"]), tables, targets, protocol.get("gene_expression") or {})
    return df


def dry_run(spark: SparkSession, protocol: dict, names: list[str], most: int = 200) -> DataFrame:
    """(probe, n, n_empty, shortest, longest) of each probe and part over windows of made-up bases.

    For the first ``most`` names; of each allowed length at least eight windows, so that several probe numbers occur.
    Nothing is read and no attribute is computed; n_empty counts the windows for which an expression fails.
    """
    length = protocol["extracts"]["target_region"]["length"]
    n = (length if isinstance(length, int) else length[1]) + 7 * protocol["extracts"]["target_region"].get("step", 1)
    bases = ("ACGTTGCAAGCTTCGA" * (n // 16 + 1))[:n]
    direct = {k: v for k, v in protocol["extracts"]["target_region"].items() if k not in ("source", "transcripts", "masked")}
    w = candidates(protocol | {"extracts": {"target_region": direct}}, spark.createDataFrame([(t, bases) for t in names[:most]], "target string, seq string"))
    built = F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), F.length(k.replace(".", "__")).alias("size")) for k in nodes(protocol["probes"])]))
    return w.select(built.alias("x")).groupBy("x.probe").agg(F.count("*").alias("n"), F.count_if(F.col("x.size") == 0).alias("n_empty"), F.min("x.size").alias("shortest"), F.max("x.size").alias("longest"))


def run(protocol: dict, targets: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The design of a protocol over targets: windows, layouts, probes, attributes, selection, numbers.

    ``targets`` has the column target, and seq where ``extracts`` names no source (see ``extraction`` for the tables that
    sources read). Attributes that are expressions stay row by row in one projection over the numbered windows, with the
    filters on them; what is left is kept once, and those of ``similarity`` then search the ``tables`` (see there) for
    it; what passes all filters is kept again, as the steps behind read it several times, and so is the design before it is
    sorted, once. Candidates are numbered in order of extraction (segment, start, size, layout), which also breaks all ties;
    ``final_index`` numbers the result's rows of each target in its order. Probes that read probe_index are made again
    with the final numbers along the target, and declared modifications stand beside the sequences.

    The protocol runs as it stands: a step written as an empty block runs with its defaults. ``rewrite.pruned`` takes such
    blocks as placeholders and leaves them out, ``rewrite.normalised`` also adds what is missing; call them before.
    """
    found = analyse(protocol)
    if found:
        raise ValueError("; ".join(found))
    tables = tables or {}
    w = add_attributes(candidates(protocol, targets, tables), protocol)
    for k in protocol["probes"]:
        w = w.where(F.length(k) > 0)
    if any((a.get("exempt_copies") for a in (protocol.get("attributes") or {}).values())):
        targets = extraction.sequences(protocol, targets, tables)
    w, site_columns = _searched(w, protocol, tables, targets)
    post = protocol.get("post_process") or {}
    w = kept(selection.filter_table(w, post.get("filters") or {}, strict=True))
    out = post_process(w, {k: v for k, v in post.items() if k != "filters"}, site_columns=site_columns, ordered=False)
    sorts = post.get("sorts") or {}
    up, down = sorts.get("is_ascending") or [], sorts.get("is_descending") or []
    keys = selection.rank_order(out, up, down)
    out = out.withColumn("final_index", F.row_number().over(Window.partitionBy("target").orderBy(*keys)) - 1)
    out = renumbered(out, protocol, [F.col("final_index")], tables, targets)
    return finishing.annotate(selection.sort_table(kept(out), up, down), protocol["probes"])  # a sort samples its rows first, which would make them twice


#: The keys that a protocol's blocks may have; all of them are carried out, or describe and do nothing.
TOP = ("name", "description", "meta", "genome", "targets", "encoding", "extracts", "probes", "hybridization", "attributes", "post_process", "gene_expression", "summary")
REGION = ("source", "transcripts", "masked", "length", "step", "overlap", "layout")
STEPS = {"filters": None, "avoid_otp": None, "sorts": ("is_ascending", "is_descending"), "remove_overlap": ("location_interval", "prefer"), "off_target_pool": ("attribute", "max_probes_per_gene"), "equal_space": None}
REACTION = ("temperature_c", *CONDITIONS)
OPTIONS = {
    "base_fraction": ("bases", "positions"), "max_homopolymer": ("bases", "positions"), "max_window_count": ("bases", "window", "positions"), "rna_dna_dg37": ("sequence",), "fold_score": REACTION, "blocks": ("offset",),
    "annealing_temperature": ("tm_method", *REACTION), "difference": ("of",), "mapped_genes": ("aligner", "max_mismatches", "strand", "oligos", "max_gap", "exempt_copies"),
    "mapped_sites": ("aligner", "max_mismatches", "strand"), "kmer_count": ("kmer_len", "aligner", "strand", "locus_only", "size", "threads"),
}
EXPRESSION = ("min_value", "min_fraction_of_target", "absent", "level")


def unknown_keys(protocol: dict) -> list[str]:
    """Keys that nothing reads, each with its place: a misspelled option must not pass in silence."""
    out = []

    def check(at: str, given: object, known: tuple[str, ...]) -> None:
        out.extend(f"{at}{'.' if at else ''}{k}: unknown key{closest(str(k), list(known))}" for k in (given if isinstance(given, dict) else {}) if k not in known)

    check("", protocol, TOP)
    check("extracts.target_region", (protocol.get("extracts") or {}).get("target_region"), REGION)
    check("hybridization", protocol.get("hybridization"), REACTION)
    check("gene_expression", protocol.get("gene_expression"), EXPRESSION)
    for name, a in (protocol.get("attributes") or {}).items():
        if a.get("type") in (*ATTRIBUTES, "difference", *similarity.TYPES):
            check(f"attributes.{name}", a, ("type", "target", "hybridization", *OPTIONS.get(a["type"], ())))
            check(f"attributes.{name}.hybridization", a.get("hybridization"), REACTION)
    post = protocol.get("post_process") or {}
    check("post_process", post, tuple(STEPS))
    for step, known in STEPS.items():
        if known:
            check(f"post_process.{step}", post.get(step), known)
    for name, f in (post.get("filters") or {}).items():
        check(f"post_process.filters.{name}", f, ("condition", "type", "target", "exclude_patterns", "patterns"))
    return out


def analyse(protocol: dict) -> list[str]:
    """All problems of a protocol, each with its place."""
    out = [f"{k}: missing" for k in REQUIRED if k not in protocol]
    if out:
        return out
    region = (protocol["extracts"] or {}).get("target_region")
    if not isinstance(region, dict) or "length" not in region:
        return ["extracts.target_region.length: missing"]
    out += unknown_keys(protocol) + extraction.problems(region)
    if (protocol.get("gene_expression") or {}).get("level", "gene") != "gene":
        out.append("gene_expression.level: only levels of genes are known")
    try:
        all_nodes = nodes(protocol["probes"])
        ordered(all_nodes)
    except (ValueError, AttributeError) as e:
        return [f"probes: {e}"]
    layout = (region.get("layout") or {}).get("parts") or {}
    names = {"target_region", "target", "encoding", "probe_index", *(f"target_parts.{p}" for p in layout)}
    for k, n in all_nodes.items():
        if n.expr is not None:
            here = {r for r in _safe_references(n.expr) if _resolve(r, k, all_nodes)}
            out += [f"probes.{k}: {p}" for p in problems(n.expr, names | here)]
        elif n.template is None:
            out.append(f"probes.{k}: needs an expr or a template")
        else:
            out += [f"probes.{k}: template names {r!r}, which is no part or probe" for r in needs(n) if not _resolve(r, k, all_nodes)]
    out += finishing.declaration_problems(protocol["probes"])
    attributes = protocol.get("attributes") or {}
    columns = {x.replace(".", "__") for x in names} | {k.replace(".", "__") for k in all_nodes}
    for k, a in attributes.items():
        if a.get("type") not in (*ATTRIBUTES, "difference", *similarity.TYPES):
            out.append(f"attributes.{k}: unknown type {a.get('type')!r}{closest(str(a.get('type')), list(ATTRIBUTES))}")
        elif a["type"] != "difference" and column_name(str(a.get("target"))) not in columns:
            out.append(f"attributes.{k}: no column {a.get('target')!r}{closest(str(a.get('target')), sorted(columns))}")
        elif a["type"] in similarity.TYPES:
            out += similarity.problems(k, a, list(layout))
        elif a["type"] == "fold_score" and conditions(protocol, a).get("temperature_c", finishing.BODY) != finishing.BODY:
            out.append(f"attributes.{k}: energies are known at 37 degrees only")
    placed = {"target_start", "target_end", "n_trans"} if region.get("source") in extraction.RNA else set()
    there = {*attributes, "start", "end", "tm_diff", *placed, *columns, *(c for k, a in attributes.items() if a.get("type") in similarity.TYPES for c in similarity.columns(k, a["type"]))}
    post = protocol.get("post_process") or {}
    if post.get("avoid_otp") and not any(a.get("type") == "mapped_sites" for a in attributes.values()):
        out.append("post_process.avoid_otp: needs an attribute of type mapped_sites")
    if "off_target_pool" in post and (attributes.get((post["off_target_pool"] or {}).get("attribute")) or {}).get("type") != "mapped_genes":
        out.append("post_process.off_target_pool.attribute: names no attribute of type mapped_genes")
    for k, f in (post.get("filters") or {}).items():
        for text in [f["condition"]] if isinstance(f.get("condition"), str) else f.get("condition") or []:
            try:
                for c, _, _ in selection.parse_condition(text):
                    if c not in there:
                        out.append(f"post_process.filters.{k}: no column {c!r}{closest(c, list(attributes))}")
            except ValueError as e:
                out.append(f"post_process.filters.{k}: {e}")
    return out


def _safe_references(text: str) -> list[str]:
    try:
        return references(text)
    except ExpressionError:
        return []


def closest(word: str, known: list[str]) -> str:
    """A hint at the known word that shares most letter pairs, if it shares half."""
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    own = pairs(word)
    best = max(known, key=lambda k: 2 * len(own & pairs(k)) / max(1, len(own) + len(pairs(k))), default=None)
    return f"; did you mean {best!r}?" if best and 2 * len(own & pairs(best)) >= 0.5 * (len(own) + len(pairs(best))) else ""


def with_defaults(protocol: dict, temperature: bool = False) -> dict:
    """The protocol with GC and temperature attributes and a GC filter for its first probe where it has none.

    With ``temperature`` also the filter of ``finishing.temperature_window``, for probes of the usual lengths.
    """
    if protocol.get("attributes"):
        return protocol
    first = next(iter(protocol["probes"]))
    attributes = {"target_gc": {"target": "target_region", "type": "gc_content"}, "probe_tm": {"target": first, "type": "annealing_temperature"}}
    filters = {"target_gc": {"condition": "target_gc >= 0.4 & target_gc <= 0.6"}}
    if temperature:
        low, high, _ = finishing.temperature_window(protocol | {"attributes": attributes}, "probe_tm", CONDITIONS)
        filters["probe_tm"] = {"condition": f"probe_tm >= {low} & probe_tm <= {high}"}
    post = {"filters": filters, "remove_overlap": {"location_interval": 0}} | (protocol.get("post_process") or {})
    return protocol | {"attributes": attributes, "post_process": post}


def clean_names(names: list[str]) -> list[str]:
    """Target names without outer white space and format characters, blanks dropped, the first of each kept."""
    return [n for n in dict.fromkeys(re.sub(r"^[\s​﻿]+|[\s​﻿]+$", "", x) for x in names) if n]


def outcome(funnel: DataFrame) -> DataFrame:
    """The status of each group from ``summary.run_summary``: all, some or none."""
    return funnel.withColumn("outcome", F.when(F.col("final") == 0, "none").when(F.col("final") < F.col("candidates"), "some").otherwise("all"))


__all__ = ["analyse", "candidates", "construct", "dry_run", "load", "nodes", "ordered", "outcome", "post_process", "run", "summary", "template_column", "with_defaults"]
