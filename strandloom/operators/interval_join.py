"""Joins on overlapping intervals, near positions and enclosing ranges.

An interval is cut into bins of a fixed width, both sides are joined on (keys, bin), and a pair is
kept only in the bin where the later of both begins, so it comes out once without a distinct. The
width is taken from the data: about the 90th percentile of the shorter side's lengths. Bins are
counted, and a key and bin with very many intervals on the left is split by salting those and
repeating the few of the right that meet them; other bins aren't repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intervals of the left side in one part of a bin.
PART = 100_000


def bin_width(df: DataFrame, begin: str, end: str, least: int = 16) -> int:
    """A power of two at or above the 90th percentile of the lengths (approximate, one small aggregate)."""
    p = df.agg(F.percentile_approx(F.col(end) - F.col(begin), 0.9, 1000)).first()[0]
    width = least
    while p is not None and width < p:
        width *= 2
    return width


def _binned(df: DataFrame, begin: Column, end: Column, width: int) -> DataFrame:
    last = F.greatest(end - 1, begin)
    return df.withColumn("bin_", F.explode(F.sequence(F.floor(begin / width).cast("long"), F.floor(last / width).cast("long"))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", begin: str = "begin", end: str = "end", width: int | None = None, part: int = PART) -> DataFrame:
    """Rows of ``left`` and ``right`` whose half-open intervals overlap and whose ``keys`` are equal.

    ``how``: ``inner`` and ``left`` give pairs with the right side's columns named ``r_<name>``;
    ``semi`` and ``anti`` the left rows with and without an overlap; ``count`` the left rows with
    ``n_overlaps``. Touching intervals don't overlap; an empty interval overlaps one it lies
    strictly inside. Rows with a null key or bound overlap nothing. Repeated rows are kept, each for
    itself. Bins with more than ``part`` intervals of the left side are split in parts of about that size.
    """
    if how not in ("inner", "left", "semi", "anti", "count"):
        raise ValueError(f"how: {how}")
    width = width or bin_width(right, begin, end)
    names = left.columns
    l = left.withColumn("row_", F.monotonically_increasing_id()) if how != "inner" else left
    if how != "inner":  # the ids must be the same wherever the side is read again
        from strandloom.storage import materialise

        l = materialise(l, "left")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = [F.col(k) == F.col(f"r_{k}") for k in keys]
    lb, rb = (_binned(d.filter(f"{p}{begin} is not null and {p}{end} is not null"), F.col(p + begin), F.col(p + end), width) for d, p in ((l, ""), (r, "r_")))
    # few bins are that full, whatever the size of the tables
    counted = lb.groupBy(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("bin_").alias("h_bin_")).agg(F.count(F.lit(1)).alias("h_n_")).filter(F.col("h_n_") > part)
    hot = counted.withColumn("h_parts_", F.ceil(F.col("h_n_") / part).cast("int")).drop("h_n_")

    def parts(d: DataFrame, p: str) -> DataFrame:
        same = d["bin_"] == hot["h_bin_"]
        for k in keys:
            same = same & (d[p + k] == hot[f"h_{k}"])
        return d.join(hot, same, "left").withColumn("parts_", F.coalesce("h_parts_", F.lit(1))).drop(*hot.columns)

    # by content, so that a task that runs again gives every row the same part
    own = [F.col(c) for c in names if not lb.schema[c].dataType.simpleString().startswith("map")]
    lb = parts(lb, "").withColumn("salt_", F.pmod(F.xxhash64(*own), F.col("parts_")).cast("int")).drop("parts_")
    rb = parts(rb, "r_").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    on.append(lb["salt_"] == rb["salt_"])
    meet = (F.col(begin) < F.col(f"r_{end}")) & (F.col(f"r_{begin}") < F.col(end))
    first = F.floor(F.greatest(begin, f"r_{begin}") / width).cast("long")
    cond = (lb["bin_"] == rb["bin_"]) & meet & (lb["bin_"] == first)
    for c in on:
        cond = cond & c
    pairs = lb.join(rb, cond)
    if how == "inner":
        return pairs.select(*names, *r.columns)
    if how == "left":
        hit = pairs.select("row_", *r.columns)
        return l.join(hit, "row_", "left").select(*names, *r.columns)
    counts = pairs.groupBy("row_").agg(F.count(F.lit(1)).alias("n_overlaps"))
    if how == "count":
        return l.join(counts, "row_", "left").select(*names, F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"))
    return l.join(counts.select("row_"), "row_", f"left_{how}").select(*names)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, below: int, above: int) -> DataFrame:
    """Pairs whose ``right_pos`` lies in [left_pos - below, left_pos + above); right columns as ``r_<name>``.

    Rows with a null key or position have no partner.
    """
    width = max(1, below + above)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("rbin_", F.floor(F.col(f"r_{right_pos}") / width))
    first, last = F.floor((F.col(left_pos) - below) / width), F.floor((F.col(left_pos) + above - 1) / width)
    l = left.filter(F.col(left_pos).isNotNull()).withColumn("lbin_", F.explode(F.sequence(first, last)))
    cond = (F.col("lbin_") == F.col("rbin_")) & (F.col(f"r_{right_pos}") >= F.col(left_pos) - below) & (F.col(f"r_{right_pos}") < F.col(left_pos) + above)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"r_{k}"))
    return l.join(r, cond).drop("lbin_", "rbin_")


def enclosing_range(points: DataFrame, pos: str, ranges: DataFrame, begin: str, end: str) -> DataFrame:
    """Points joined with the one range [begin, end) of a disjoint set that encloses them; others are dropped.

    The ranges are sorted against the points by a union and a running last value within coarse
    tiles, so no side is broadcast whatever its size.
    """
    from pyspark.sql import Window

    tile = 1 << 20
    p = points.filter(F.col(pos).isNotNull()).select(F.floor(F.col(pos) / tile).alias("tile_"), F.col(pos).alias("at_"), F.struct(*points.columns).alias("p_"), F.lit(None).cast(ranges.select(F.struct(*ranges.columns).alias("x")).schema["x"].dataType).alias("g_"))
    g = ranges.filter(f"{begin} is not null and {end} > {begin}").withColumn("tile_", F.explode(F.sequence(F.floor(F.col(begin) / tile), F.floor((F.col(end) - 1) / tile))))
    g = g.select("tile_", F.greatest(F.col(begin), F.col("tile_") * tile).alias("at_"), F.lit(None).cast(p.schema["p_"].dataType).alias("p_"), F.struct(*ranges.columns).alias("g_"))
    by = Window.partitionBy("tile_").orderBy("at_", F.col("p_").isNotNull())
    seen = p.unionByName(g).withColumn("in_", F.last("g_", True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.filter(f"p_ is not null and in_.{end} > at_").select("p_.*", "in_.*")
