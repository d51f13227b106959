"""Connected components of a table of links, without gathering links anywhere.

Every round each node points at the smallest node it can see (large star, then small star); the
links are written to the shared folder between rounds. The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.storage import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of a link; a component is named by its smallest node.

    Links with a null end and links of a node with itself are left out; repeated links change
    nothing; no links, no rows.
    """
    now = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().filter("u <> v").distinct()
    last = None
    for _ in range(rounds):
        now = materialise(_small_star(_large_star(now)), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    ends = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select("v").distinct()
    return ends.select(F.col("u").alias("node"), "component").unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
