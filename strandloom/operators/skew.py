"""Per-key statistics that stay balanced when a few keys hold most rows.

Rows are range partitioned on (key, position) with Spark's sampled quantiles, so a heavy key is
spread over as many partitions as its share asks for. Each partition emits one partial state per
key; the partial states are stitched by running sums, and the median is then looked up in the one
or two partitions that hold the middle ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.storage import materialise


def usual_name(chrom: Column, contigs: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with the column ``usual``: the usual name of a chromosome spelling.

    Blanks around the spelling are dropped; a spelling that isn't in ``contigs`` stands for itself;
    null and blank spellings give null.
    """
    names = contigs.groupBy("spelling").agg(F.min("chrom").alias("usual_chrom"))
    keyed = df.withColumn("spelling_key", F.nullif(F.trim(chrom), F.lit("")))
    joined = keyed.join(names, keyed.spelling_key == names.spelling, "left")
    return joined.withColumn("usual", F.coalesce("usual_chrom", "spelling_key")).drop("spelling_key", "spelling", "usual_chrom")


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, by key, how many rows stand up to and with each position."""
    part = TaskContext.get().partitionId()
    last, carried = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0)
        n = b.column(2).to_numpy(zero_copy_only=False) * np.asarray(b.column(1).is_valid())
        coded = keys.dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        upto = np.cumsum(n)
        base = np.where(new > 0, upto[new - 1], 0)
        first = keys[0].as_py()
        runs = upto - np.repeat(base, np.diff(np.r_[new, len(n)]))
        if first == last and carried:
            runs[: new[1] if len(new) > 1 else len(n)] += carried
        last, carried = keys[-1].as_py(), int(runs[-1])
        yield pa.RecordBatch.from_arrays([keys, b.column(1), b.column(2), pa.array(np.full(len(n), part, "int32")), pa.array(runs.astype("int64"))], ["k", "p", "n", "part", "upto"])


def key_statistics(df: DataFrame, key: str, position: str, partitions: int | None = None) -> DataFrame:
    """One row per key: ``k, n_rows, n_positions, median_position, n_partitions``.

    ``n_rows`` counts all rows of the key, ``n_positions`` its distinct non-null positions,
    ``median_position`` is the mean of the two middle positions (one position if their number is
    odd). A null key is a key of its own; a key with only null positions has a null median; an
    empty table gives no rows. Other columns of ``df`` are ignored whatever their names.
    """
    counted = df.select(F.col(key).alias("k"), F.col(position).cast("long").alias("p")).groupBy("k", "p").agg(F.count(F.lit(1)).alias("n"))
    by = ["k", "p"]
    ranged = counted.repartitionByRange(partitions, *by) if partitions else counted.repartitionByRange(*by)
    kind = df.schema[key].dataType.simpleString()
    table = materialise(ranged.sortWithinPartitions(*by).mapInArrow(_ranks, f"k {kind}, p long, n long, part int, upto long"), "ranges")
    states = table.groupBy("k", "part").agg(F.sum("n").alias("rows"), F.count("p").alias("positions"), F.coalesce(F.sum(F.when(F.col("p").isNotNull(), F.col("n"))), F.lit(0)).alias("placed"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("k")
    stitched = states.select(
        "k", "part", "rows", "positions", "placed",
        F.coalesce(F.sum("placed").over(before), F.lit(0)).alias("offset"),
        F.sum("placed").over(whole).alias("total"),
    )
    totals = stitched.groupBy("k").agg(F.sum("rows").alias("n_rows"), F.sum("positions").alias("n_positions"), F.count(F.lit(1)).alias("n_partitions"))
    wanted = stitched.select("k", "part", "offset", "placed", F.explode(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1"))).alias("rank"))
    wanted = wanted.filter("rank > offset and rank <= offset + placed").select(F.col("k").alias("wk"), F.col("part").alias("wpart"), (F.col("rank") - F.col("offset")).alias("local"))
    found = table.filter("p is not null").join(wanted, F.expr("k <=> wk and part = wpart and local > upto - n and local <= upto"))
    medians = found.groupBy("k").agg(F.avg("p").alias("median_position")).withColumnRenamed("k", "mk")
    return totals.join(medians, F.expr("k <=> mk"), "left").select("k", "n_rows", "n_positions", "median_position", "n_partitions")


def heavy_keys(stats: DataFrame, share: float) -> DataFrame:
    """The keys, null apart, that hold at least ``share`` of the rows of all non-null keys."""
    known = stats.filter("k is not null")
    return known.filter(F.col("n_rows") >= F.lit(share) * known.agg(F.sum("n_rows")).scalar())
