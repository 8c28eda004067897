"""The source stage of a protocol: windows along transcripts, gene segments, genome regions or given sequences.

``extracts.target_region`` names a source. ``mRNA``, ``exon``, ``CDS`` and ``UTR`` read the table ``annotation`` (rows of
``readers.parse_gtf``: chr, type, start, end, strand, gene_name, transcript_id, tags) and ``contigs`` (name, seq);
``genome`` reads regions ``chr:start-end`` of the contigs, without soft-masked or unknown bases, and without those that
the table ``mask`` (chrom, start0, end0) marks, where ``masked`` is ``drop``. Without a source the targets bring their
sequences (target, seq).

A target of which ``transcripts`` chooses exactly one is tiled along its spliced sequence, over the junctions; others
along each segment, with positions on the merged model of all segments. Every window has target_region, start and end
(in its segments), target_start and target_end (along the target), probe_id, and what orders it: segment, start0, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import annotation, intervals
from ..operators.windows import number_within, sliding_windows
from ..session import spread
from ..sources.readers import region_sequence

RNA = ("mRNA", "exon", "CDS", "UTR")
RULES = ("all", "canonical", "mane")
#: Tags of transcripts, the first that a gene has counts.
TAGS = {"mane": ("MANE_Select", "Ensembl_canonical"), "canonical": ("Ensembl_canonical",)}
SHOWN = 20


def lengths(region: dict) -> tuple[int, int]:
    n = region["length"]
    return (n, n) if isinstance(n, int) else tuple(n)


def step_of(region: dict) -> int:
    """``step``, or what ``overlap`` leaves of the shortest window."""
    if region.get("overlap") is not None:
        return lengths(region)[0] - region["overlap"]
    return region.get("step", 1)


def problems(region: dict) -> list[str]:
    """What is wrong with the source's options."""
    out, at = [], "extracts.target_region"
    source = region.get("source")
    if source not in (None, "genome", *RNA):
        out.append(f"{at}.source: unknown source {source!r}")
    rule = region.get("transcripts", "all")
    if not (rule in RULES if isinstance(rule, str) else isinstance(rule, list) and rule and all(isinstance(x, str) and x.strip() for x in rule)):
        out.append(f"{at}.transcripts: must be all, canonical, mane or a list of transcripts")
    if "transcripts" in region and source not in RNA:
        out.append(f"{at}.transcripts: only sources of RNA have transcripts")
    if region.get("masked", "keep") not in ("keep", "drop"):
        out.append(f"{at}.masked: must be keep or drop")
    if region.get("masked") == "drop" and source != "genome":
        out.append(f"{at}.masked: only the source genome is masked")
    if region.get("step") is not None and region.get("overlap") is not None:
        out.append(f"{at}: step and overlap exclude each other")
    elif not isinstance(step_of(region), int) or step_of(region) < 1:
        out.append(f"{at}.step: must be a whole number from 1, overlap less than the length")
    return out


def refuse(missing: DataFrame, what: str) -> None:
    """An error that names the first of the targets for which something is missing."""
    names = [str(r[0]) for r in missing.limit(SHOWN + 1).collect()]
    if names:
        raise ValueError(f"{what}: " + ", ".join(names[:SHOWN]) + (", ..." if len(names) > SHOWN else ""))


def chosen(rows: DataFrame, rule: str | list) -> DataFrame:
    """(target, transcript_id) that a rule or a list chooses of the targets' rows; all that bear the tag that counts."""
    known = rows.where("transcript_id is not null").select("target", "transcript_id", "tags")
    if isinstance(rule, list):
        wanted = rows.sparkSession.createDataFrame([(x.strip(),) for x in rule], "wanted string")
        return annotation.listed_transcripts(known, wanted, "target", "transcript_id")
    rank = F.lit(None).cast("int")
    for k, tag in reversed(list(enumerate(TAGS[rule]))):
        rank = F.when(F.array_contains("tags", tag), k).otherwise(rank)
    ranked = known.withColumn("k_", rank).where("k_ is not null")
    best = ranked.groupBy(F.col("target").alias("t_")).agg(F.min("k_").alias("b_"))
    return ranked.join(best, (F.col("target") == F.col("t_")) & (F.col("k_") == F.col("b_"))).select("target", "transcript_id").distinct()


def segments(region: dict, targets: DataFrame, annotation_: DataFrame) -> DataFrame:
    """The targets' rows of the annotation that a source of RNA extracts, with ``spliced``: of one chosen transcript."""
    rows = annotation_.join(targets.select("target").distinct(), F.col("gene_name") == F.col("target"))
    refuse(targets.select("target").distinct().join(rows.select("target").distinct(), "target", "left_anti"), "extracts: targets that the annotation lacks")
    rule = region.get("transcripts", "all")
    if rule == "all":
        rows = rows.withColumn("spliced", F.lit(False))
    else:
        pairs = chosen(rows, rule)
        refuse(targets.select("target").distinct().join(pairs.select("target").distinct(), "target", "left_anti"), "extracts.target_region.transcripts: targets without one")
        one = pairs.groupBy("target").agg((F.count("*") == 1).alias("spliced"))
        rows = rows.join(pairs, ["target", "transcript_id"], "left_semi").join(one, "target")
    if region["source"] == "UTR":
        rows = rows.withColumn("spliced", F.lit(False))
    return annotation.select_segments(rows, "target", "type", "CDS" if region["source"] == "exon" else region["source"])


def _name(sep: str, *columns: str) -> Column:
    return F.concat_ws(sep, *columns)


def _spliced(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """(target, seq, parts): a transcript's segments joined 5' to 3'; parts: name, a, b (0-based, half-open) along seq."""
    one = rows.select("target", "chr", "start", "end", "strand", "transcript_id").distinct()
    one = region_sequence(one, contigs, "chr", "start", "end", "strand")
    place = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    parts = F.array_sort(F.collect_list(F.struct(place.alias("place"), _name("_", "chr", "start", "end", "strand").alias("name"), F.col("seq").alias("seq"))))
    whole = one.groupBy("target").agg(F.min("transcript_id").alias("transcript_id"), parts.alias("p"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<name:string,a:int,b:int>>").alias("x"))
    ends = F.aggregate("p", start, lambda z, x: F.struct((z["n"] + F.length(x["seq"])).alias("n"), F.array_append(z["x"], F.struct(x["name"].alias("name"), z["n"].alias("a"), (z["n"] + F.length(x["seq"])).alias("b"))).alias("x")))
    return whole.select("target", "transcript_id", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"), ends["x"].alias("parts"))


def _spliced_windows(whole: DataFrame, low: int, high: int, step: int) -> DataFrame:
    w = sliding_windows(spread(whole, "target"), "seq", low, high, step)  # few bytes, but all windows' work follows in their tasks
    touched = F.filter("parts", lambda x: (x["a"] < F.col("start0") + F.col("size")) & (x["b"] > F.col("start0")))
    w = w.withColumn("t_", touched)
    first = F.col("start0") + 1 - F.get("t_", F.lit(0))["a"]
    return w.select(
        "target", F.lit(0).cast("long").alias("segment"), "start0", "size", F.col("window").alias("target_region"), F.array_join("t_.name", ";").alias("exon_name"),
        F.array("transcript_id").alias("transcript_names"), F.lit(1).cast("long").alias("n_trans"), first.cast("long").alias("start"), (first + F.col("size") - 1).cast("long").alias("end"),
        (F.col("start0") + 1).cast("long").alias("target_start"), (F.col("start0") + F.col("size")).cast("long").alias("target_end"),
    )


def _models(rows: DataFrame) -> DataFrame:
    """``rows`` with segment (their number within the target) and offset along the target's merged model; models of
    several contigs or strands follow each other."""
    groups = ["target", "chr", "strand"]
    out = annotation.merged_offsets(rows, groups, "start", "end", F.col("strand"))
    size = out.groupBy(*groups).agg(F.max(F.col("block_offset") + F.col("block_end") - F.col("block_start") + 1).alias("size_"))
    earlier = size.alias("x").join(size.alias("y"), (F.col("x.target") == F.col("y.target")) & (F.struct("y.chr", "y.strand") < F.struct("x.chr", "x.strand")))
    before = earlier.groupBy("x.target", "x.chr", "x.strand").agg(F.sum("y.size_").alias("before_"))
    out = out.join(before, groups, "left").withColumn("offset", F.col("offset") + F.coalesce("before_", F.lit(0)))
    return number_within(out, ["target"], ["chr", "start", "end", "strand", "name"], "segment").drop("before_", "block_start", "block_end", "block_offset")


def _segment_windows(rows: DataFrame, contigs: DataFrame, region: dict) -> DataFrame:
    low, high = lengths(region)
    if region["source"] != "mRNA":
        rows = rows.where(F.col("end") - F.col("start") + 1 >= low)
    keys = ["target", "chr", "start", "end", "strand"]
    if region["source"] == "UTR":
        kept = rows.select(*keys, F.array().cast("array<string>").alias("transcript_names"), F.lit(1).cast("long").alias("n_trans"), _name("_", "target", "start", "end").alias("name"))
    else:
        kept = annotation.merge_segments(rows, keys, "transcript_id").withColumn("name", _name("_", "chr", "start", "end", "strand"))
    kept = region_sequence(_models(kept), contigs, "chr", "start", "end", "strand")
    w = sliding_windows(spread(kept.withColumnsRenamed({"start": "s_", "end": "e_"}), "target"), "seq", low, high, step_of(region))
    first, last = (F.col("start0") + 1).cast("long"), (F.col("start0") + F.col("size")).cast("long")
    return w.select(
        "target", "segment", "start0", "size", F.col("window").alias("target_region"), F.col("name").alias("utr_name" if region["source"] == "UTR" else "exon_name"),
        "transcript_names", F.col("n_trans").cast("long").alias("n_trans"), first.alias("start"), last.alias("end"), (F.col("offset") + first).alias("target_start"), (F.col("offset") + last).alias("target_end"),
    )


def _genome_windows(targets: DataFrame, region: dict, tables: dict[str, DataFrame]) -> DataFrame:
    low, high = lengths(region)
    at, name = F.split(F.substring_index("target", ":", -1), "-"), F.substring_index("target", ":", 1)
    regions = targets.select("target").distinct().withColumns({"chr": name, "a": F.get(at, F.lit(0)).try_cast("long"), "b": F.get(at, F.lit(1)).try_cast("long")})
    refuse(regions.where("a is null or b is null or b < a or a < 1").select("target"), "targets that are no regions chr:start-end")
    drop = region.get("masked", "keep") == "drop"
    found = region_sequence(regions, tables["contigs"], "chr", "a", "b", upper=False)
    refuse(found.where("seq is null").select("target"), "extracts: regions that no contig has")
    w = sliding_windows(spread(found.select("target", "chr", "a", "seq"), "target"), "seq", low, high, step_of(region))
    w = number_within(w.drop("seq"), ["target"], ["start0", "size"], "n_", 1)
    if drop:
        w = w.where(~F.col("window").rlike("[a-zN]"))
    if drop and "mask" in tables:
        bare = lambda c: F.regexp_replace(c, "^chr", "")
        w = w.withColumns({"c_": bare("chr"), "x_": F.col("a") - 1 + F.col("start0"), "y_": F.col("a") - 1 + F.col("start0") + F.col("size")})
        mask = tables["mask"].select(bare("chrom").alias("c_"), F.col("start0").alias("m_"), F.col("end0").alias("n0_"))
        w = intervals.without_overlap(w, mask, ["c_"], "x_", "y_", "m_", "n0_", 1 << 12, ["target", "n_"])
    return w.select(
        "target", F.lit(0).cast("long").alias("segment"), "start0", "size", F.upper("window").alias("target_region"), "n_",
        (F.col("start0") + 1).cast("long").alias("start"), (F.col("start0") + F.col("size")).cast("long").alias("end"),
    )


def windows(protocol: dict, targets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """All windows of the targets (target; with seq where the protocol names no source), as the module's head says."""
    region = protocol["extracts"]["target_region"]
    low, high = lengths(region)
    source = region.get("source")
    if source in RNA:
        rows = segments(region, targets, _table(tables, "annotation"))
        contigs = _table(tables, "contigs")
        w = None
        if region["source"] != "UTR" and region.get("transcripts", "all") != "all":
            w = _spliced_windows(_spliced(rows.where("spliced"), contigs), low, high, step_of(region))
        if w is None or isinstance(region["transcripts"], list) or not one_each(rows):
            by_segment = _segment_windows(rows.where(~F.col("spliced")), contigs, region)
            w = by_segment if w is None else w.unionByName(by_segment)
        w = number_within(w, ["target"], ["segment", "start0", "size"], "n_", 1)
        sub = _name("_", "start", "end")
    elif source == "genome":
        _table(tables, "contigs")
        w, sub = _genome_windows(targets, region, tables), _name("-", "start", "end")
    else:
        w = sliding_windows(targets, "seq", low, high, step_of(region)).drop("seq")
        w = w.withColumns({"segment": F.lit(0).cast("long"), "target_region": F.col("window"), "start": (F.col("start0") + 1).cast("long"), "end": (F.col("start0") + F.col("size")).cast("long")}).drop("window")
        return w
    return w.withColumns({"probe_id": _name("_", "target", "n_"), "sub_region": sub}).drop("n_")


def one_each(rows: DataFrame) -> bool:
    """Whether each target has one chosen transcript; then no window lies along single segments."""
    return rows.where(~F.col("spliced")).limit(1).isEmpty()


def sequences(protocol: dict, targets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(target, seq): what the windows of targets are taken from, segments apart by an N."""
    region = protocol["extracts"]["target_region"]
    if region.get("source") in RNA:
        rows = segments(region, targets, _table(tables, "annotation"))
        one = region_sequence(rows.select("target", "chr", "start", "end", "strand", "spliced").distinct(), _table(tables, "contigs"), "chr", "start", "end", "strand")
        place = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "seq"))), lambda x: x["seq"])
        return one.groupBy("target").agg(F.when(F.bool_and("spliced"), F.array_join(parts, "")).otherwise(F.array_join(parts, "N")).alias("seq"))
    if region.get("source") == "genome":
        at = F.split(F.substring_index("target", ":", -1), "-")
        regions = targets.select("target").distinct().withColumns({"chr": F.substring_index("target", ":", 1), "a": at[0].cast("long"), "b": at[1].cast("long")})
        return region_sequence(regions, _table(tables, "contigs"), "chr", "a", "b").select("target", "seq")
    return targets.select("target", "seq")


def _table(tables: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"extracts.target_region.source: needs the table {name!r}")
    return tables[name]


__all__ = ["chosen", "problems", "segments", "sequences", "windows"]
