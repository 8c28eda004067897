"""Attributes of a protocol that need other tables: sites in records, genes hit, k-mer counts.

``tables`` of a run may hold

* ``records`` (record, seq): transcripts named ``gene_transcript``, for ``mapped_genes``;
* ``genes`` (gene[, label, biotype]): names, and the kinds that ``exempt_copies`` needs;
* ``target_genes`` (target, gene): the genes that are a target; without it a target is the gene of its name;
* ``expression`` (gene, value); ``genome`` (record, seq), for ``kmer_count`` and ``mapped_sites``;
* ``records_index``, ``genome_index``: a ``seeds.SeedIndex`` of these tables, which all attributes and runs may share.

Each attribute searches the distinct sequences that the cheaper filters have left, and is joined back by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, search, seeds

TYPES = ("mapped_genes", "mapped_sites", "kmer_count")
#: What a protocol's options mean where they are left out.
MISMATCHES, STRAND = 2, "both"
#: Columns that an attribute adds beside its own.
BESIDE = {"mapped_genes": ("off_targets", "unexpressed", "copies"), "mapped_sites": ("num",), "kmer_count": ()}


def columns(name: str, kind: str) -> list[str]:
    return [name, *(f"{name}_{x}" for x in BESIDE[kind])]


def problems(name: str, spec: dict, parts: list[str]) -> list[str]:
    """What is wrong with the options of one attribute."""
    out = []
    if spec["type"] == "mapped_genes":
        m = spec.get("max_mismatches", MISMATCHES)
        if not isinstance(m, int) or isinstance(m, bool) or not 0 <= m <= 3:
            out.append(f"max_mismatches must be 0 to 3, not {m!r}")
        if spec.get("aligner", "bowtie") not in ("bowtie", "bowtie2"):
            out.append(f"unknown aligner {spec['aligner']!r}")
        oligos = spec.get("oligos")
        if oligos is not None and (not isinstance(oligos, list) or len(oligos) < 2):
            out.append("oligos must list at least two layout parts")
        for o in oligos if isinstance(oligos, list) else []:
            out += [f"oligos: no layout part {p!r}" for p in ([o] if isinstance(o, str) else o) if p not in parts]
        if spec.get("max_gap") is not None and oligos is None:
            out.append("max_gap only applies with oligos")
    if spec["type"] == "kmer_count" and not isinstance(spec.get("kmer_len"), int):
        out.append("kmer_len: missing")
    if spec.get("strand", STRAND) not in ("both", "sense", "antisense"):
        out.append(f"strand must be both, sense or antisense, not {spec['strand']!r}")
    return [f"attributes.{name}: {x}" for x in out]


def _needed(tables: dict[str, DataFrame], name: str, table: str) -> DataFrame:
    if table not in tables:
        raise ValueError(f"attributes.{name}: needs the table {table!r}")
    return tables[table]


def _unit(spec: dict, column: str) -> Column:
    """What is searched for: the column's sequence, or the sequences of its oligos, which tell layouts of a window apart."""
    return F.concat_ws("|", *_oligos(spec)) if spec.get("oligos") else F.col(column)


def _oligos(spec: dict) -> list[Column]:
    return [F.concat(*(F.col(f"target_parts__{p}") for p in ([o] if isinstance(o, str) else o))) for o in spec["oligos"]]


def _sites(queries: DataFrame, tables: dict, table: str, column: str, mismatches: int, strand: str) -> DataFrame:
    """The sites of ``column`` in a table: from its index where the run has one, with the same result."""
    if (index := tables.get(f"{table}_index")) is not None:
        return seeds.indexed_sites(queries, index, column, mismatches, strand)
    return search.mismatch_sites(queries, tables[table], column, "record", "seq", mismatches, strand)


def _genes_hit(df: DataFrame, spec: dict, column: str, tables: dict) -> DataFrame:
    """(query, gene, mismatches) of the distinct sequences of ``column``; units of several oligos where they are named."""
    n, strand = spec.get("max_mismatches", MISMATCHES), spec.get("strand", STRAND)
    if spec.get("aligner", "bowtie") == "bowtie2":
        return search.fewest_mismatches(_local_sites(df.select(column), tables["records"], column, strand))
    if not spec.get("oligos"):
        return search.fewest_mismatches(_sites(df.select(column), tables, "records", column, n, strand))
    members = df.select(_unit(spec, column).alias("unit"), F.explode(F.array(*_oligos(spec))).alias("oligo")).distinct()
    hits = _sites(members, tables, "records", "oligo", n, strand)
    whole = search.units(members, hits, "unit", "oligo", spec.get("max_gap"))
    return search.fewest_mismatches(whole.withColumnRenamed("unit", "query"))


def _local_sites(queries: DataFrame, records: DataFrame, column: str, strand: str) -> DataFrame:
    """(query, strand, record, start0, end0, mismatches = 0) of gapped local alignments, on the strands that are asked for."""
    return alignment.local_sites(queries, records, column, "record", "seq", strand).drop("score").withColumn("mismatches", F.lit(0))


def _copies(spec: dict, name: str, tables: dict[str, DataFrame], targets: DataFrame, records: DataFrame) -> DataFrame | None:
    """(target, gene): genes that are not protein coding and hold enough of a target's k-mers."""
    if not spec.get("exempt_copies"):
        return None
    genes = _needed(tables, name, "genes")
    if "biotype" not in genes.columns:
        raise ValueError(f"attributes.{name}: exempt_copies needs biotypes in the table 'genes'")
    o = spec["exempt_copies"]
    share = search.shared_kmers(targets, records, "target", "seq", "record", "seq", o.get("kmer", 30)).where(F.col("share") >= o.get("min_shared", 0.5))
    other = genes.where(F.coalesce(F.col("biotype") != "protein_coding", F.lit(False))).select("gene")
    return share.select("target", search.gene_of(F.col("record")).alias("gene")).distinct().join(other, "gene", "left_semi")


def _mapped_genes(df: DataFrame, name: str, spec: dict, column: str, tables: dict, targets: DataFrame, options: dict) -> DataFrame:
    records = _needed(tables, name, "records")
    hits = _genes_hit(df, spec, column, tables)
    own = df.select(_unit(spec, column).alias("query"), "target").distinct()
    genes = tables.get("target_genes")
    own = own.join(genes.select("target", "gene"), "target", "left") if genes is not None else own.withColumn("gene", F.col("target"))
    labels = tables["genes"].select("gene", "label") if "label" in getattr(tables.get("genes"), "columns", ()) else None  # names that the hits would give are searched for again
    e = options if tables.get("expression") is not None else {}
    level = {"expression": tables["expression"], "least": float(e.get("min_value", 0)), "fraction": float(e.get("min_fraction_of_target", 0)), "absent": e.get("absent", "count")} if tables.get("expression") is not None else {}
    found = search.annotate(hits, own, labels, copies=_copies(spec, name, tables, targets, records), **level)
    found = found.select(F.col("query").alias("q_"), F.col("target").alias("t_"), F.col("mapped_genes").alias(name), *(F.col(x).alias(f"{name}_{x}") for x in BESIDE["mapped_genes"]))
    out = df.join(found.hint("merge"), _unit(spec, column).eqNullSafe(F.col("q_")) & F.col("target").eqNullSafe(F.col("t_")), "left").drop("q_", "t_")
    return out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def add(df: DataFrame, name: str, spec: dict, column: str, tables: dict[str, DataFrame], targets: DataFrame, options: dict) -> DataFrame:
    """``df`` with one attribute's columns; ``targets`` (target, seq) are the run's, ``options`` its gene_expression."""
    if spec["type"] == "mapped_genes":
        return _mapped_genes(df, name, spec, column, tables, targets, options)
    genome = _needed(tables, name, "genome")
    if spec["type"] == "kmer_count":
        found = search.max_kmer_count(df.select(column).distinct(), genome, column, "seq", spec["kmer_len"], spec.get("strand", STRAND) == "both", bool(spec.get("locus_only")))
        return df.join(found.select(F.col(column).alias("q_"), F.col("kmer_count").cast("long").alias(name)), F.col(column).eqNullSafe(F.col("q_")), "left").drop("q_")
    local = spec.get("aligner") == "bowtie2"
    sites = _local_sites(df.select(column), genome, column, spec.get("strand", STRAND)) if local else _sites(df.select(column), tables, "genome", column, spec.get("max_mismatches", 0), spec.get("strand", STRAND))
    sites = search.site_lists(sites)
    found = sites.select(F.col("query").alias("q_"), F.col("mapped_sites").alias(name), F.col("mapped_sites_num").alias(f"{name}_num"))
    return df.join(found, F.col(column).eqNullSafe(F.col("q_")), "left").drop("q_").withColumn(f"{name}_num", F.coalesce(f"{name}_num", F.lit(0).cast("long")))


def listed_genes(column: Column) -> Column:
    """The genes of a list like ``a:0, b:2``; null and the empty list have none."""
    names = F.transform(F.split(column, ", "), lambda x: F.regexp_replace(x, r":\d+$", ""))
    return F.when(F.length(column) > 0, names).otherwise(F.array().cast("array<string>"))
