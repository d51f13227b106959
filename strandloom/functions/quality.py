"""Base qualities and error probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 33


def phred(char: Column, strict_reference: bool = False) -> Column:
    """The quality of a character; the reference takes the character's own code, without the offset."""
    return F.ascii(char) - (0 if strict_reference else OFFSET)


def error_probability(char: Column, strict_reference: bool = False) -> Column:
    return F.pow(F.lit(10.0), phred(char, strict_reference) / -10.0)


def log10_error_probability(char: Column, strict_reference: bool = False) -> Column:
    return phred(char, strict_reference) / -10.0


def log10_correct_probability(char: Column, strict_reference: bool = False) -> Column:
    """Null for quality 0, which is never right."""
    p = error_probability(char, strict_reference)
    return F.when(p < 1, F.log10(1 - p))


def phred_scaled(probability: Column) -> Column:
    """-10 log10 of an error probability; null for 0."""
    return F.when(probability > 0, -10 * F.log10(probability))


def mean_quality(qual: Column) -> Column:
    """Null for an empty string."""
    n = F.length(qual)
    total = F.aggregate(F.filter(F.split(qual, ""), lambda c: F.length(c) > 0), F.lit(0), lambda s, c: s + F.ascii(c) - OFFSET)
    return F.when(n > 0, total / n)


def trim_end(seq: Column, qual: Column, least: int) -> Column:
    """``seq`` up to its last base whose quality reaches the least."""
    good = f"[{_class(least)}]"
    kept = F.length(F.regexp_replace(qual, f"[^{_class(least)}]+\\z", ""))
    return F.when(qual.rlike(good), F.substr(seq, F.lit(1), kept)).otherwise("")


def _class(least: int) -> str:
    first, last = chr(OFFSET + least), "~"
    return f"\\x{ord(first):02x}-\\x{ord(last):02x}"


def blurry(seq: Column, share: float = 0.1) -> Column:
    """Whether more letters than ``ceil(share * length)`` are unknown."""
    n = F.length(seq)
    known = F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))
    return (n - known) > F.ceil(F.lit(share) * n)
