"""Interval functions over (chrom, begin, end, strand), 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: End of an interval that names a chromosome only.
UNBOUNDED = 4294967295

_TEXT = r"^([+-]?)([^:]*)(?::([0-9]+)(?:(\+)|-([0-9]+))?)?$"


def interval(chrom: Column, begin: Column, end: Column, strand: Column | str = "+") -> Column:
    strand = F.lit(strand) if isinstance(strand, str) else strand
    return F.struct(chrom.alias("chrom"), begin.cast("long").alias("begin"), end.cast("long").alias("end"), strand.alias("strand"))


def parse(text: Column) -> Column:
    """The interval of ``[+-]chrom[:begin[-end]]`` or ``[+-]chrom:begin+``; commas don't matter.

    Without a begin it is the whole chromosome, without an end a single base. Fails on other text
    and where begin is beyond end.
    """
    plain = F.replace(text, F.lit(","), F.lit(""))
    part = lambda i: F.regexp_extract(plain, _TEXT, i)
    given = lambda i: F.when(part(i) != "", part(i).cast("long"))
    begin = F.coalesce(given(3), F.lit(0).cast("long"))
    end = F.when(part(3) == "", F.lit(UNBOUNDED)).when(part(4) == "+", F.lit(UNBOUNDED)).otherwise(F.coalesce(given(5), begin + 1))
    wrong = F.raise_error(F.concat(F.lit("not an interval: "), text))
    found = interval(part(2), begin, end, F.when(part(1) == "-", "-").otherwise("+"))
    return F.when(text.isNull(), F.lit(None)).when(plain.rlike(_TEXT) & (begin <= end), found).otherwise(wrong.cast("struct<chrom:string,begin:bigint,end:bigint,strand:string>"))


def size(x: Column) -> Column:
    return x["end"] - x["begin"]


def is_empty(x: Column) -> Column:
    return x["end"] == x["begin"]


def show(x: Column) -> Column:
    return F.concat(x["strand"], x["chrom"], F.lit(":"), x["begin"].cast("string"), F.lit("-"), x["end"].cast("string"))


def _same_line(a: Column, b: Column) -> Column:
    return (a["chrom"] == b["chrom"]) & (a["strand"] == b["strand"])


def overlaps(a: Column, b: Column) -> Column:
    """Touching intervals don't overlap."""
    return _same_line(a, b) & (a["begin"] < b["end"]) & (b["begin"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return _same_line(a, b) & (a["begin"] <= b["begin"]) & (a["end"] >= b["end"])


def span(a: Column, b: Column) -> Column:
    """The least interval with both; fails on different chromosomes or strands."""
    both = interval(a["chrom"], F.least(a["begin"], b["begin"]), F.greatest(a["end"], b["end"]), a["strand"])
    return F.when(_same_line(a, b), both).otherwise(F.raise_error(F.lit("intervals of different lines")).cast("struct<chrom:string,begin:bigint,end:bigint,strand:string>"))


def expand(x: Column, by: int, strict_reference: bool = False) -> Column:
    """``by`` bases more on either side, clamped at 0; on request the begin wraps as 32 unsigned bits do."""
    begin = x["begin"] - by
    begin = F.pmod(begin, F.lit(1 << 32)) if strict_reference else F.greatest(begin, F.lit(0).cast("long"))
    return interval(x["chrom"], begin, x["end"] + by, x["strand"])
