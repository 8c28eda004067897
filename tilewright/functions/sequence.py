"""Sequence functions as Catalyst columns: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA = "ACGT"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest_bases(key: Column | str) -> Column:
    """Thirty-two bases from the MD5 digest of a key."""
    return F.translate(F.md5(_c(key).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def reverse_complement(s: Column | str) -> Column:
    """A-C-G-T (either case) complemented and reversed, N kept; null if any other letter occurs."""
    s = _c(s)
    return F.when(~s.rlike("[^ACGTNacgtn]"), F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca")))


def canonical(s: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(_c(s), reverse_complement(s))


def clean_dna(s: Column | str) -> Column:
    """Upper case with U as T; null unless two bases or more, all of A, C, G, T."""
    up = F.translate(F.upper(_c(s)), "U", "T")
    return F.when(up.rlike("^[ACGT]{2,}$"), up)


def count_bases(s: Column | str, bases: str) -> Column:
    s = _c(s)
    return F.length(s) - F.length(F.translate(s, bases, ""))


def gc_content(s: Column | str) -> Column:
    """Share of G and C, case-sensitive; null for the empty sequence."""
    return F.when(F.length(_c(s)) > 0, count_bases(s, "GC") / F.length(_c(s)))


def part(s: Column | str, positions: tuple[int, int] | None) -> Column:
    """Upper-case bases at 1-based inclusive positions, negative ones from the end, clipped to the sequence."""
    up = F.translate(F.upper(_c(s)), "U", "T")
    if positions is None:
        return up
    n = F.length(up)
    a, b = (F.lit(p) if p > 0 else n + (p + 1) for p in positions)
    a, b = F.greatest(a, F.lit(1)), F.greatest(b, F.lit(0))
    return F.when(b >= a, F.substring(up, a, b - a + 1)).when(up.isNotNull(), F.lit(""))


def base_fraction(s: Column | str, bases: str, positions: tuple[int, int] | None = None) -> Column:
    p = part(s, positions)
    return F.when(F.length(p) > 0, count_bases(p, bases) / F.length(p))


def max_homopolymer(s: Column | str, bases: str = DNA, positions: tuple[int, int] | None = None) -> Column:
    """Longest run of one of the bases; 0 if none."""
    runs = [F.array_max(F.transform(F.regexp_extract_all(part(s, positions), F.lit(f"{b}+"), F.lit(0)), F.length)) for b in bases]
    return F.when(_c(s).isNotNull(), F.greatest(*[F.coalesce(r, F.lit(0)) for r in runs], F.lit(0)))


def max_window_count(s: Column | str, bases: str, window: int, positions: tuple[int, int] | None = None) -> Column:
    """Most of the bases in any run of ``window``; a shorter sequence counts whole."""
    p = part(s, positions)
    starts = F.sequence(F.lit(1), F.greatest(F.length(p) - window + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda i: count_bases(F.substring(p, i, F.lit(window)), bases)))


def kmers(s: Column | str, k: int) -> Column:
    """All k-mers in order; none for a shorter sequence."""
    s = _c(s)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def dna_kmers(s: Column | str, k: int) -> Column:
    """K-mers of A, C, G, T only."""
    return F.filter(kmers(s, k), lambda x: ~x.rlike("[^ACGT]"))


def self_match(s: Column | str, size: int = 4) -> Column:
    """Pairs (i, j) of equal words of a sequence and its reverse complement, but those with i + j + size - 2 = length."""
    s = _c(s)
    both = F.array(F.struct(kmers(s, size).alias("a"), kmers(reverse_complement(s), size).alias("b"), F.length(s).alias("n")))  # made once a row

    def pairs(t: Column) -> Column:
        all_ = F.aggregate(t["a"], F.lit(0), lambda n, x: n + F.size(F.filter(t["b"], lambda y: x == y)))
        return all_ - F.size(F.filter(t["a"], lambda x, i: F.coalesce((i > 1) & (x == F.get(t["b"], t["n"] - (size - 2) - i)), F.lit(False))))

    return F.get(F.transform(both, pairs), F.lit(0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions that differ; null for unequal lengths."""
    a, b = _c(a), _c(b)
    both = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    return F.when(F.length(a) == F.length(b), F.aggregate(both, F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int")))


def packed_bases(s: Column | str) -> Column:
    """Up to 31 letters of ACGT as a number of two bits each; null for other words."""
    s = _c(s)
    plain = (F.length(s) <= 31) & (F.length(s) > 0) & (F.length(F.translate(s, "ACGT", "")) == 0)
    return F.when(plain, F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("bigint"))


def packed_distance(a: Column, b: Column) -> Column:
    """Bases that differ between two packed words of one length."""
    both = a.bitwiseXOR(b)
    either = both.bitwiseOR(F.shiftrightunsigned(both, 1))
    return F.bit_count(either.bitwiseAND(F.lit(0x5555555555555555)))


def occurrences(text: Column | str, word: Column | str) -> Column:
    """1-based starts of all, also overlapping, occurrences of a word."""
    text, word = _c(text), _c(word)
    n = F.length(text) - F.length(word) + 1
    return F.when((n > 0) & (F.length(word) > 0), F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.length(word)) == word)).otherwise(F.array().cast("array<int>"))


def cigar_reference_length(cigar: Column | str) -> Column:
    """Bases of the reference that a CIGAR string spans: M, D, N, = and X."""
    ops = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(ops, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def quoted_attribute(info: Column | str, name: str) -> Column:
    """The value of ``name "value"`` in a GTF information field; null if absent or blank."""
    v = F.trim(F.regexp_extract(_c(info), rf'(?:^|;)\s*{name} "([^"]*)"', 1))
    return F.when(v != "", v)


def strip_version(name: Column | str) -> Column:
    """``ID.12`` as ``ID``; a trailing ``_PAR_Y`` stays."""
    return F.regexp_replace(_c(name), r"\.\d+(?=$|_PAR_Y$)", "")


def strip_ensembl_version(name: Column | str) -> Column:
    """As ``strip_version``, for Ensembl gene ids only."""
    name = _c(name)
    return F.when(name.rlike(r"^ENS[A-Z]*G\d+"), strip_version(name)).otherwise(name)


def region_bounds(text: Column | str) -> tuple[Column, Column]:
    """Start and end of ``s-e`` or ``s_e``; null if it is neither."""
    text = _c(text)
    ends = [F.regexp_extract(text, r"^(\d+)[-_](\d+)$", i) for i in (1, 2)]
    return tuple(F.when(e != "", e.cast("long")) for e in ends)  # type: ignore[return-value]


def genome_region(text: Column | str) -> tuple[Column, Column, Column]:
    """Name, start and end of ``name:start-end``; null unless 1 <= start <= end."""
    text = _c(text)
    p = r"^([^:]+):(\d+)-(\d+)$"
    name, a, b = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2).try_cast("long"), F.regexp_extract(text, p, 3).try_cast("long")
    ok = (name != "") & (a >= 1) & (b >= a)
    return F.when(ok, name), F.when(ok, a), F.when(ok, b)


def split_list(text: Column | str, sep: str = ",") -> Column:
    """Trimmed, non-empty items."""
    return F.filter(F.transform(F.split(_c(text), sep), lambda x: F.trim(x)), lambda x: x != "")


def truthy(text: Column | str) -> Column:
    return F.lower(F.trim(_c(text))).isin("1", "true", "yes", "y", "t")


def clipped(text: Column | str, most: int, mark: str = "...") -> Column:
    """A cell of at most ``most`` characters, cut ones ending in a mark."""
    text = _c(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)
