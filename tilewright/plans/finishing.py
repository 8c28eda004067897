"""What follows a design: chemistry beside the sequences, the order of the result's columns, windows of temperature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand at an end, and what may stand on a bond between two bases.
AT_ENDS = ("phosphate", "hydroxyl", "fluorophore")
ON_BONDS = ("disulfide", "phosphorothioate")
#: Letters of nucleotide sequences.
NUCLEOTIDES = "ACGTURYSWKMBDHVN"
#: Suffixes of the columns of lists beside an attribute.
LISTS = ("_off_targets", "_unexpressed", "_hit_transcripts", "_copies")
#: Reaction conditions where a protocol gives none.
CONDITIONS = {"na_mM": 50, "mg_mM": 0, "dntp_mM": 0.6, "probe_nM": 50, "formamide_pct": 0}
#: Temperatures that a filter asks for where no conditions are declared; the width where they are; degrees.
WIDE_WINDOW, WIDTH, BODY = (50, 90), 40, 37
CHEMISTRY = "array<struct<probe:string,type:string,position:string,name:string,after_base:int>>"


@dataclass(frozen=True)
class Place:
    """What may be declared at a position of a probe: types, fields beside the type, and whether it is a list."""

    types: tuple[str, ...]
    fields: tuple[str, ...]
    several: bool


PLACES = {"5prime": Place(AT_ENDS, ("name",), False), "3prime": Place(AT_ENDS, ("name",), False), "internal": Place(ON_BONDS, ("name", "after_base"), True)}
#: What each field must be: (applies to a record of a place, holds, what to say if not).
FIELD_RULES = (
    (lambda r, p: True, lambda r, p: r.get("type") in p.types, "type {type!r} does not go here"),
    (lambda r, p: True, lambda r, p: {*r} <= {"type", *p.fields}, "unknown field besides type, {fields}"),
    (lambda r, p: r.get("type") == "fluorophore", lambda r, p: str(r.get("name") or "").strip() != "", "a fluorophore has a name"),
    (lambda r, p: r.get("type") != "fluorophore", lambda r, p: str(r.get("name") or "").strip() == "", "only a fluorophore has a name"),
    (lambda r, p: "after_base" in p.fields, lambda r, p: type(r.get("after_base")) is int and r["after_base"] > 0, "after_base must be a whole number from 1"),
)


def modifications(probe: str, spec: object) -> tuple[list[dict], list[str]]:
    """(records, problems) of what a probe declares: ``5prime`` and ``3prime`` hold one, ``internal`` a list of bonds.

    A bond is named by the base before it, counted from 1. One place holds one modification, the first that is named.
    """
    here = f"probes.{probe}.modifications"
    if not isinstance(spec, dict):
        return [], [f"{here}: must map 5prime, 3prime or internal"]
    found = [f"{here}.{k}: unknown position" for k in spec if k not in PLACES]
    found += [f"{here}.{k}: must be a list" for k, v in spec.items() if k in PLACES and PLACES[k].several and not isinstance(v, list)]
    named = [(f"{here}.{k}", k, v) for k, v in spec.items() if k in PLACES and not PLACES[k].several]
    named += [(f"{here}.{k}[{i}]", k, v) for k, items in spec.items() if k in PLACES and PLACES[k].several and isinstance(items, list) for i, v in enumerate(items)]
    records: dict[tuple, dict] = {}
    for at, position, given in named:
        place = PLACES[position]
        record = {"type": given} if isinstance(given, str) and not place.several else given
        wrong = ["must have a type"] if not isinstance(record, dict) else [
            text.format(type=record.get("type"), fields=", ".join(place.fields)) for applies, holds, text in FIELD_RULES if applies(record, place) and not holds(record, place)
        ]
        full = {"probe": probe, "position": position} | ({c: record.get(c) for c in ("type", "name", "after_base")} if not wrong else {})
        if not wrong and (position, full["after_base"]) in records:
            wrong = ["this place is taken"]
        found += [f"{at}: {x}" for x in wrong[:1]]
        if not wrong:
            records[position, full["after_base"]] = full
    return list(records.values()), found


def declaration_problems(probes: dict) -> list[str]:
    """Problems of all declarations; only probes carry modifications, their parts do not."""
    out = []

    def parts(spec: object, at: str) -> None:
        for k, v in ((spec.get("parts") or {}) if isinstance(spec, dict) else {}).items():
            if isinstance(v, dict) and "modifications" in v:
                out.append(f"{at}.parts.{k}.modifications: only probes carry modifications")
            parts(v, f"{at}.parts.{k}")

    for name, spec in probes.items():
        if isinstance(spec, dict) and spec.get("modifications") is not None:
            out += modifications(name, spec["modifications"])[1]
            if "modifications" in (spec.get("parts") or {}):
                out.append(f"probes.{name}.parts.modifications: this name is the metadata column's")
        parts(spec, f"probes.{name}")
    return out


def annotate(df: DataFrame, probes: dict) -> DataFrame:
    """``df`` with ``<probe>__modifications`` for each probe that declares some; sequences stay as they are.

    The job fails at a row whose sequence has other letters than nucleotides, or no room for a declared bond.
    """
    for name, spec in probes.items():
        declared = spec.get("modifications") if isinstance(spec, dict) else None
        if not declared:
            continue
        records, found = modifications(name, declared)
        if found:
            raise ValueError("; ".join(found))
        least = max([1, *(r["after_base"] + 1 for r in records if r["after_base"])])
        wrong = F.when(~F.upper(name).rlike(f"^[{NUCLEOTIDES}]*$"), F.concat(F.lit(f"probes.{name}: not a nucleotide sequence: "), F.col(name))).when(F.length(name) < least, F.concat(F.lit(f"probes.{name}.modifications: needs {least} bases: "), F.col(name)))
        rows = F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in ("probe", "type", "position", "name", "after_base")]) for r in records]).cast(CHEMISTRY)
        df = df.withColumn(f"{name}__modifications", F.when(wrong.isNotNull(), F.raise_error(wrong).cast(CHEMISTRY)).otherwise(rows))
    return df


def ordered_columns(columns: list[str], protocol: dict) -> list[str]:
    """Metadata, then for each sequence itself, its parts, and its attributes, each followed by its lists."""
    attributes = protocol.get("attributes") or {}
    regions = protocol.get("extracts") or {}
    parts = ["target_parts"] if (regions.get("target_region") or {}).get("layout") else []
    groups = list(dict.fromkeys(["target_region", *parts, *regions, *(protocol.get("probes") or {})]))
    at = {c: i for i, c in enumerate(columns)}

    def place(c: str) -> tuple:
        owner = next((c.removesuffix(s) for s in LISTS if c.endswith(s) and c.removesuffix(s) in attributes), c)
        target = str((attributes.get(owner) or {}).get("target", owner)).replace(":", ".").replace("__", ".")
        fits = [g for g in groups if target == g or target.startswith(g + ".")]
        if not fits:
            return (-1, 0, at[c], 0, 0)
        rank = 0 if c in fits else 2 if owner in attributes else 1
        return (groups.index(max(fits, key=len)), rank, at.get(owner, at[c]), int(owner != c), at[c])

    return sorted(columns, key=place)


def result_table(df: DataFrame, protocol: dict) -> DataFrame:
    """The columns that a result shows, in their order: without start and end, transcript names as text."""
    if "transcript_names" in df.columns:
        names = F.col("transcript_names")
        df = df.withColumn("transcript_names", list_text(names) if dict(df.dtypes)["transcript_names"] == "string" else F.coalesce(F.array_join(names.cast("array<string>"), "; "), F.lit("")))
    return df.select(*[f"`{c}`" for c in ordered_columns([c for c in df.columns if c not in ("start", "end")], protocol)])


def parsed_list(c: Column) -> Column:
    """The items of a list that is written as text, ``['a', "b"]`` or ``(1, 2)``; null for other text."""
    items = F.regexp_extract_all(c, F.lit(r"""'[^']*'|"[^"]*"|[^\s,'"()\[\]]+"""), F.lit(0))
    return F.when(c.rlike(r"^\s*(\[.*\]|\(.*\))\s*$"), F.transform(items, lambda x: F.regexp_replace(x, r"""^['"]|['"]$""", "")))


def list_text(c: Column) -> Column:
    """A written list joined by ``; ``; other text as it is; the empty text for null."""
    return F.coalesce(F.array_join(parsed_list(c), "; "), c, F.lit(""))


def file_stem(name: str) -> str:
    """A name as the start of a file's name: other characters than letters, digits, ``_``, ``.`` and ``-`` as ``_``."""
    kept = ["_" if not c.isalnum() and c not in "_.-" else c for c in str(name)]
    while kept and kept[0] == ".":
        kept.pop(0)
    return "".join(kept) if kept else "probes"


def file_stem_column(c: Column) -> Column:
    """As ``file_stem``."""
    stem = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w.-]", "_"), r"^\.+", "")
    return F.when(F.length(stem) > 0, stem).otherwise("probes")


def temperature_window(protocol: dict, name: str, defaults: dict) -> tuple[float, float, str | None]:
    """(low, high, source) of the filter that is made for an attribute's melting temperature.

    From the temperature of its reaction, so many degrees up: the attribute's own ('attribute'), else the protocol's
    ('protocol'), else body temperature where other conditions are declared ('default'). Without any, and where the
    attribute declares other conditions but no temperature, a wide window without a source.
    """
    given = {"protocol": protocol.get("hybridization") or {}, "attribute": own_conditions((protocol.get("attributes") or {}).get(name) or {}, defaults)}
    stated = {(who, condition): value for who, block in given.items() for condition, value in block.items()}
    reaction = {**defaults, **given["protocol"], **given["attribute"]}
    elsewhere = any(reaction[c] != (defaults | given["protocol"])[c] for c in defaults)  # the attribute's own reaction is another one
    sources = [
        (stated.get(("attribute", "temperature_c")), "attribute"),
        (None if elsewhere else stated.get(("protocol", "temperature_c")), "protocol"),
        (BODY if not elsewhere and any(("protocol", c) in stated for c in defaults) else None, "default"),
    ]
    for low, source in sources:
        if low is not None:
            return low, low + WIDTH, source
    return (*WIDE_WINDOW, None)


def own_conditions(attribute: dict, defaults: dict) -> dict:
    """The reaction conditions that an attribute declares for itself, in its block or beside its type."""
    return {k: v for k, v in attribute.items() if k in defaults or k == "temperature_c"} | (attribute.get("hybridization") or {})
