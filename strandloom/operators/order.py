"""Ordering operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.storage import materialise


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row in the order of ``by``, nulls first.

    Rows are range partitioned, numbered within their partition, and shifted by the sizes of the
    partitions before, so no task sees more than its range.
    """
    from pyspark import TaskContext

    names = df.columns

    def tag(batches):
        import numpy as np
        import pyarrow as pa

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, "int32")), pa.array(np.arange(n + 1, n + b.num_rows + 1))], [*names, "part_", "local_"])
            n += b.num_rows

    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    t = materialise(ranged.mapInArrow(tag, f"{fields}, part_ int, local_ long"), "ranked")
    sizes = t.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part_", F.coalesce(before, F.lit(0)).alias("offset_"))
    return t.join(offsets, "part_").select(*names, (F.col("local_") + F.col("offset_")).alias(name))


def ranked_within(df: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row among those of its ``key``, by range partitions of (key, by): a heavy key isn't one task."""
    placed = ranked(df, [key, *by], "place_")
    first = placed.groupBy(key).agg(F.min("place_").alias("first_")).withColumnRenamed(key, "k_")
    return placed.join(first, F.col(key).eqNullSafe(F.col("k_"))).select(*df.columns, (F.col("place_") - F.col("first_") + 1).alias(name))


def differences(xs: Column) -> Column:
    """Each value of an array less the one before, the first as it is."""
    return F.transform(xs, lambda x, i: x - F.when(i > 0, F.get(xs, i - 1)).otherwise(0))


def second_smallest(xs: Column) -> Column:
    """Null for fewer than two values."""
    return F.get(F.array_sort(xs), F.lit(1))
