"""Continuous periods of overlapping intervals, and the gaps between them.

Overlaps are merged by Spark's own ``session_window`` with a duration that differs from row to
row. A key's line is cut into tiles first, and rows with equal start are reduced to the longest, so
that one key with a third of all rows is still many small groups. Tiles are stitched by carrying
the furthest end of all earlier tiles, which also joins periods that only touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a tile; bounds the number of rows in any group.
TILE = 1 << 16


def merge_periods(df: DataFrame, keys: list[str], start: str, end: str, tile: int = TILE) -> DataFrame:
    """One row per continuous period: ``*keys, period_start, period_end, gap_end``.

    Intervals are half-open. Periods that touch are one; ``gap_end`` is the start of the key's next
    period (so the gap is ``[period_end, gap_end)``), null after the last. Rows with a null key, a
    null bound, a negative start or an end not above the start are left out. Repeated rows change
    nothing; an empty table gives no rows; columns other than those named are ignored.
    """
    k = [f"key_{i}" for i in range(len(keys))]
    base = df.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    base = base.dropna().filter("s >= 0 and e > s")
    longest = base.groupBy(*k, "s").agg(F.max("e").alias("e"))
    timed = longest.withColumn("at", F.timestamp_micros("s")).withColumn("tile", F.expr(f"s div {int(tile)}"))
    lasting = F.make_interval(secs=((F.col("e") - F.col("s")).cast("decimal(18,6)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    sessions = timed.groupBy(*k, "tile", F.session_window("at", lasting)).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    sessions = sessions.select(*k, "tile", "s", "e")

    tiles = sessions.groupBy(*k, "tile").agg(F.max("e").alias("furthest"))
    earlier = Window.partitionBy(*k).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(*k, "tile", F.max("furthest").over(earlier).alias("carried"), F.max("furthest").over(Window.partitionBy(*k)).alias("last_end"))

    inside = Window.partitionBy(*k, "tile").orderBy("s")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sessions.join(tiles, [*k, "tile"])
        .withColumn("reached", F.greatest(F.col("carried"), F.max("e").over(so_far)))
        .filter("reached is null or s > reached")
        .withColumn("next_reached", F.lead("reached").over(inside))
        .withColumn("next_s", F.lead("s").over(inside))
    )
    firsts = starts.groupBy(*k, "tile").agg(F.min_by(F.struct("reached", "s"), "s").alias("head"))
    later = Window.partitionBy(*k).orderBy("tile")
    firsts = firsts.select(*k, "tile", F.lead("head").over(later).alias("after"))
    whole = starts.join(firsts, [*k, "tile"]).select(
        *[F.col(n).alias(c) for n, c in zip(k, keys)],
        F.col("s").alias("period_start"),
        F.coalesce("next_reached", "after.reached", "last_end").alias("period_end"),
        F.coalesce("next_s", "after.s").alias("gap_end"),
    )
    return whole


def gaps(periods: DataFrame) -> DataFrame:
    """The gaps of ``merge_periods``' result, as ``*keys, gap_start, gap_end``."""
    keys = [c for c in periods.columns if c not in ("period_start", "period_end", "gap_end")]
    return periods.filter("gap_end is not null").select(*keys, F.col("period_end").alias("gap_start"), "gap_end")
