"""Expression matrices in long form ``(sample, gene, value)``: counts, filling, normalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.order import ranked_within
from strandloom.storage import materialise


def gene_counts(hits: DataFrame, read: str, gene: str, sample: str) -> DataFrame:
    """``sample, gene, value``: reads per gene, counting the reads that hit exactly one feature."""
    once = hits.groupBy(sample, read).agg(F.count(F.lit(1)).alias("n"), F.min(gene).alias("gene")).filter("n = 1")
    return once.groupBy(F.col(sample).alias("sample"), "gene").agg(F.count(F.lit(1)).alias("value"))


def tail_class(tail: Column) -> Column:
    """0-3 for tails of A, C, G, T or U only, 4 for others, 5 for none."""
    t = F.upper(tail)
    out = F.when(t.isNull() | (t == ""), 5)
    for i, c in enumerate(("A", "C", "G", "TU")):
        out = out.when(t.rlike(f"^[{c}]+$") if i < 3 else t.rlike("^(T+|U+)$"), i)
    return out.otherwise(4)


def tailed_expression(alignments: DataFrame, gene: str, seq: str, tail_pos: str, hits: str) -> DataFrame:
    """``gene, tail_idx, read_len, value``: each alignment adds 1 / hits to its gene.

    ``tail_pos`` is where the tail begins, -1 or null without a tail. Alignments without hits add nothing.
    """
    has = F.col(tail_pos) >= 0
    tail = F.when(has, F.substr(F.col(seq), F.col(tail_pos) + 1, F.length(seq)))
    size = F.when(has, F.col(tail_pos)).otherwise(F.length(seq)).cast("int")
    rows = alignments.filter(F.col(hits) > 0).select(F.col(gene).alias("gene"), tail_class(tail).alias("tail_idx"), size.alias("read_len"), (1.0 / F.col(hits)).alias("value"))
    return rows.groupBy("gene", "tail_idx", "read_len").agg(F.sum("value").alias("value"))


def add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of two expression tables."""
    return a.select(*keys, "value").unionByName(b.select(*keys, "value")).groupBy(*keys).agg(F.sum("value").alias("value"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("value", F.col("value") * by)


def by_length(tailed: DataFrame) -> DataFrame:
    """``gene, read_len`` and a column for each tail class ``tail_0`` to ``tail_5``."""
    wide = tailed.groupBy("gene", "read_len").pivot("tail_idx", list(range(6))).agg(F.sum("value"))
    return wide.select("gene", "read_len", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"tail_{i}") for i in range(6)])


def tailed_sum(tailed: DataFrame) -> DataFrame:
    """``gene, value``: the expression that has a tail."""
    return tailed.groupBy("gene").agg(F.coalesce(F.sum(F.when(F.col("tail_idx") < 5, F.col("value"))), F.lit(0.0)).alias("value"))


def size_normalised(m: DataFrame) -> DataFrame:
    """Values as shares of their sample's total; a sample whose total is 0 gets nulls."""
    total = m.groupBy("sample").agg(F.sum("value").alias("total_"))
    return m.join(total, "sample").select("sample", "gene", F.try_divide("value", "total_").alias("value"))


def filled(m: DataFrame) -> DataFrame:
    """Every gene in every sample, 0 where it was missing. The result has samples x genes rows by definition."""
    samples = m.agg(F.sort_array(F.collect_set("sample"))).scalar()
    every = m.select("gene").distinct().select("gene", F.explode(samples).alias("sample"))
    return every.join(m, ["sample", "gene"], "left").select("sample", "gene", F.coalesce("value", F.lit(0).cast(m.schema["value"].dataType)).alias("value"))


def quantile_normalised(m: DataFrame) -> DataFrame:
    """``sample, gene, value, normalised`` of the filled matrix: the mean over samples of the values
    at equal rank; equal values of a sample share the mean of their ranks' means."""
    ranked = ranked_within(filled(m), "sample", ["value", "gene"], "rank_")
    means = ranked.groupBy("rank_").agg(F.avg("value").alias("mean_"))
    joined = ranked.join(means, "rank_")
    ties = joined.groupBy("sample", "value").agg(F.avg("mean_").alias("normalised"))
    return joined.join(ties, ["sample", "value"]).select("sample", "gene", "value", "normalised")


def tmm_reference(m: DataFrame, quantile: float = 0.75) -> DataFrame:
    """``sample``: the one whose upper quartile over its size is nearest to the mean of all; the first of equal ones."""
    q = m.groupBy("sample").agg((F.percentile("value", F.lit(quantile)) / F.sum("value")).alias("q"))
    mean = q.agg(F.avg("q")).scalar()
    return q.agg(F.min_by("sample", F.struct(F.abs(F.col("q") - mean), F.col("sample"))).alias("sample"))


def tmm_factors(m: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05, weighted: bool = True, least_a: float = -1e10) -> DataFrame:
    """``sample, raw, factor``: trimmed means of M values against the reference sample, and the same
    divided by their geometric mean.

    Genes with a 0 in either sample are left out; a sample without genes left, or with no M value
    away from 0, has the raw factor 1.
    """
    # the matrix is read several times below, and its rows may come from a long plan
    full = materialise(filled(m), "matrix")
    sizes = full.groupBy("sample").agg(F.sum("value").alias("n_"))
    reference = tmm_reference(full)
    full = full.join(sizes, "sample")
    ref = full.join(reference, "sample").select("gene", F.col("value").alias("r"), F.col("n_").alias("nr"))
    both = full.join(ref, "gene").filter("value > 0 and r > 0")
    o, n, r, nr = (F.col(c).cast("double") for c in ("value", "n_", "r", "nr"))
    mv = F.log2((o / n) / (r / nr))
    av = (F.log2(o / n) + F.log2(r / nr)) / 2
    var = (n - o) / n / o + (nr - r) / nr / r
    vals = both.select("sample", "gene", mv.alias("m"), av.alias("a"), var.alias("v")).filter(F.col("a") > least_a)
    of_sample = vals.groupBy("sample").agg(F.count(F.lit(1)).alias("k"), F.max(F.abs("m")).alias("far"))
    ranked = ranked_within(ranked_within(vals, "sample", ["m", "gene"], "rm"), "sample", ["a", "gene"], "ra").join(of_sample, "sample").withColumns({"rm": F.col("rm") - 1, "ra": F.col("ra") - 1})

    def within(rank: str, share: float) -> Column:
        cut = F.floor(F.col("k") * share)
        return (F.col(rank) >= cut) & (F.col(rank) < F.col("k") - cut)

    kept = ranked.filter(within("rm", trim_m) & within("ra", trim_a) & (F.col("far") >= 1e-6))
    mean = F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v")) if weighted else F.avg("m")
    raw = sizes.select("sample").join(kept.groupBy("sample").agg(mean.alias("mean_")), "sample", "left").select("sample", F.coalesce(F.pow(F.lit(2.0), "mean_"), F.lit(1.0)).alias("raw"))
    centre = raw.agg(F.avg(F.log2("raw"))).scalar()
    return raw.select("sample", "raw", (F.col("raw") / F.pow(F.lit(2.0), centre)).alias("factor"))


def tmm_normalised(m: DataFrame) -> DataFrame:
    """The filled matrix with every value divided by its sample's factor."""
    return filled(m).join(tmm_factors(m), "sample").select("sample", "gene", (F.col("value") / F.col("factor")).alias("value"))
