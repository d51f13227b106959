"""Variant functions: classes, strand bias, reference confidence."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log10

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def kind(ref: Column, alt: Column) -> Column:
    """``snp`` for equal lengths, ``insertion`` or ``deletion`` else."""
    return F.when(F.length(ref) == F.length(alt), "snp").when(F.length(ref) < F.length(alt), "insertion").otherwise("deletion")


def to_vcf_line(chrom: Column, begin: Column, ref: Column, alts: Column, qual: Column, genotype: Column, gq: Column, pls: Column) -> Column:
    """A line of a variant with a 0-based begin and one sample of ``GT:GQ:PL``."""
    sample = F.concat_ws(":", genotype, gq.cast("string"), F.array_join(F.transform(pls, lambda p: p.cast("string")), ","))
    return F.concat_ws("\t", chrom, (begin + 1).cast("string"), F.lit("."), ref, F.array_join(alts, ","), qual.cast("string"), F.lit("."), F.lit("."), F.lit("GT:GQ:PL"), sample)


#: Larger tables are scaled down to about this size, cut to whole numbers.
TARGET_SIZE = 200.0


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided probability of tables no likelier than this one."""
    n, drawn, row = a + b + c + d, a + c, c + d
    if n == 0:
        return 1.0
    choose = lambda x, y: lgamma(x + 1) - lgamma(y + 1) - lgamma(x - y + 1)
    p = lambda k: exp(choose(drawn, k) + choose(n - drawn, row - k) - choose(n, row))
    own = p(c)
    return min(1.0, sum(x for k in range(max(0, drawn + row - n), min(drawn, row) + 1) if (x := p(k)) <= own * (1 + 1e-12)))


@F.pandas_udf(DoubleType())
def fisher_strand(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Phred-scaled strand bias of a 2x2 table; null where a cell is null."""
    known: dict[tuple[int, int, int, int], float] = {}
    for cells in parts:
        out = []
        for t in zip(*cells):
            if any(x is None or x != x for x in t):
                out.append(None)
                continue
            t = tuple(int(x) for x in t)
            if t not in known:
                s, total = t, sum(t)
                if total > 2 * TARGET_SIZE:
                    s = tuple(int(x / (total / TARGET_SIZE)) for x in t)
                known[t] = abs(-10 * log10(max(fisher_exact(*s), 1e-320)))
                if len(known) > 1_000_000:
                    known.clear()
                    known[t] = abs(-10 * log10(max(fisher_exact(*s), 1e-320)))
            out.append(known[t])
        yield pd.Series(out, dtype="float64")
