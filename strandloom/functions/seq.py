"""Sequence functions as Column expressions: codes, reverse complements, k-mers, runs, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_code(base: Column) -> Column:
    """0-3 for A, C, G, T in either case, 4 for anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def from_code(code: Column) -> Column:
    """The letter of a code; N for 4 and beyond."""
    return F.when(code.between(0, 3), F.substr(F.lit("ACGT"), code + 1, F.lit(1))).otherwise("N")


def is_valid(base: Column) -> Column:
    return to_code(base) != 4


def letters(seq: Column) -> Column:
    """The letters as an array; an empty sequence gives an empty one."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def codes(seq: Column) -> Column:
    """The codes of all letters as an array."""
    return F.transform(letters(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGTN", "01234")), lambda c: c.cast("int"))


def from_codes(codes_: Column) -> Column:
    return F.array_join(F.transform(codes_, from_code), "")


def dna4(seq: Column) -> Column:
    """Upper case with every letter other than A, C, G, T as A."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def pack(seq: Column) -> Column:
    """Two bits a letter, first letter highest; letters other than A, C, G, T pack as A. At most 31 letters."""
    digits = F.translate(dna4(seq), "ACGT", "0123")
    return F.when(F.length(seq) <= 31, F.when(F.length(seq) == 0, F.lit(0)).otherwise(F.conv(digits, 4, 10).cast("long")))


def unpack(key: Column, size: int) -> Column:
    """The sequence of ``size`` letters with this packed key."""
    places = F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1))
    return F.array_join(F.transform(places, lambda i: from_code(F.expr("0").cast("int") + F.call_function("shiftright", key, (i * 2).cast("int")).bitwiseAND(3).cast("int"))), "")


def reverse_complement(seq: Column) -> Column:
    """Upper case; letters other than A, C, G, T become N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def kmers(seq: Column, k: int, stride: int = 1) -> Column:
    """All windows of ``k`` letters at steps of ``stride``; none if the sequence is shorter.

    For reads: each window is found from the sequence's beginning. Long sequences have
    ``operators.genome.kmer_places`` and ``kmer_counts``.
    """
    starts = F.sequence(F.lit(1), F.length(seq) - k + 1, F.lit(stride))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_hits(query: Column, window: Column, k: int = 8, stride: int = 7) -> Column:
    """How many of the query's strided k-mers the window has."""
    # the window is bound once: an expression inside a lambda would be computed for every k-mer
    return F.get(F.transform(F.array(window), lambda w: F.size(F.filter(kmers(query, k, stride), lambda x: F.contains(w, x)))), 0)


def split_at_unknown(seq: Column, least: int = 19) -> Column:
    """The stretches without letters other than A, C, G, T that have at least ``least`` letters."""
    return F.filter(F.split(seq, "[^ACGTacgt]+"), lambda x: F.length(x) >= least)


def usable_segments(seq: Column, qual: Column, k: int, least_quality: int = 10, offset: int = 33) -> Column:
    """Stretches of at least ``k`` letters whose bases aren't N and whose qualities reach the least."""
    joint = F.zip_with(letters(seq), letters(qual), lambda b, q: F.when((F.upper(b) != "N") & (F.ascii(q) >= least_quality + offset), b).otherwise(" "))
    return F.filter(F.split(F.array_join(joint, ""), " +"), lambda x: F.length(x) >= k)


def base_count(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(F.upper(seq), F.lit(base.upper()), F.lit("")))).cast("long")


def low_complexity(seq: Column, share: float = 0.7) -> Column:
    """Whether one base makes up at least ``share`` of the sequence; false for an empty one."""
    most = F.greatest(*(base_count(seq, b) for b in "ACGT"))
    return F.coalesce((F.length(seq) > 0) & (most >= share * F.length(seq)), F.lit(False))


def matches(a: Column, b: Column) -> Column:
    """Places within the shorter of both that have equal letters."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(letters(F.substr(a, F.lit(1), n)), letters(F.substr(b, F.lit(1), n)), lambda x, y: (F.upper(x) == F.upper(y)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal letters within the shorter of both; 0 if one is empty."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, matches(a, b) / n).otherwise(F.lit(0.0))


def mismatches(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) - matches(a, b)


def with_runs(seq: Column, runs: Column) -> Column:
    """``seq`` with N written back over ``runs``, an array of half-open [begin, end) pairs (begin, end)."""
    return F.aggregate(runs, seq, lambda s, r: F.overlay(s, F.repeat(F.lit("N"), (r["end"] - r["begin"]).cast("int")), r["begin"].cast("int") + 1))
