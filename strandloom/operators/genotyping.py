"""Aggregates over read likelihoods in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.mathx import log10_sum as pair_sum

INFORMATIVE = 0.2


def marginalised(df: DataFrame, read: str, group: str, lik: str) -> DataFrame:
    """The best likelihood of each read in each group of haplotypes."""
    return df.groupBy(read, group).agg(F.max(lik).alias(lik))


def depth_per_allele(df: DataFrame, keys: list[str], read: str, allele: str, lik: str, lead: float = INFORMATIVE) -> DataFrame:
    """``*keys, allele, depth``: reads by best allele, counting those whose best leads the second by more than ``lead``."""
    by = Window.partitionBy(*keys, read).orderBy(F.col(lik).desc(), F.col(allele))
    ranked = df.select(*keys, read, allele, F.col(lik).alias("l_"), F.lead(lik).over(by).alias("next_"), F.row_number().over(by).alias("k_"))
    kept = ranked.filter((F.col("k_") == 1) & (F.col("l_") - F.col("next_") > lead))
    return kept.groupBy(*keys, F.col(allele).alias("allele")).agg(F.count(F.lit(1)).alias("depth"))


def genotype_likelihoods(df: DataFrame, keys: list[str], read: str, allele: str, lik: str) -> DataFrame:
    """``*keys, a, b, lik``: log10 likelihoods of the diploid genotypes, summed over reads.

    A read's alleles are gathered to one array first, so genotypes are formed without a self join.
    """
    per = df.groupBy(*keys, read).agg(F.sort_array(F.collect_list(F.struct(F.col(allele).alias("x"), F.col(lik).alias("l")))).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda p, i: F.transform(F.slice("xs", i + 1, F.size("xs")), lambda q: F.struct(p["x"].alias("a"), q["x"].alias("b"), (pair_sum(p["l"], q["l"]) - F.log10(F.lit(2.0))).alias("l")))))
    return per.select(*keys, F.explode(pairs).alias("g")).groupBy(*keys, "g.a", "g.b").agg(F.sum("g.l").alias("lik"))


def log10_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``*keys, total``: log10 of the sum of powers of ten, by way of the largest value."""
    top = df.groupBy(*keys).agg(F.max(value).alias("top_"))
    joined = df.join(top, keys)
    return joined.groupBy(*keys).agg((F.first("top_") + F.log10(F.sum(F.pow(F.lit(10.0), F.col(value) - F.col("top_"))))).alias("total"))


def reference_confidence(df: DataFrame, keys: list[str], base: str, qual: str, ref: str) -> DataFrame:
    """``*keys, depth, hom_ref, het, hom_alt``: log10 likelihoods of the reference base against any other
    one over a pile of bases with Phred qualities. Rows with a null base or reference, or a quality
    that isn't above 0, don't count."""
    q = F.col(qual).cast("double")
    right, wrong = F.log10(1 - F.pow(F.lit(10.0), -q / 10)), -q / 10 - F.log10(F.lit(3.0))
    same = F.col(base) == F.col(ref)
    rows = df.filter(F.col(base).isNotNull() & F.col(ref).isNotNull() & (q > 0)).select(*keys, F.when(same, right).otherwise(wrong).alias("r_"), F.when(same, wrong).otherwise(right).alias("a_"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"), F.sum("r_").alias("hom_ref"), F.sum(pair_sum(F.col("r_"), F.col("a_")) - F.log10(F.lit(2.0))).alias("het"), F.sum("a_").alias("hom_alt"))
