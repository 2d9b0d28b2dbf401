"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint_dir


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (two columns of one orderable type); root is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum joined
    back, until nothing changes; every round is cut by checkpoint(). Both joins
    are on columns whose large partitions Spark can split, so a hub with most
    of the links doesn't meet in one task. Self-links and repeated links don't
    matter; rows with a null are left out. No link reaches the driver.
    """
    checkpoint_dir(links.sparkSession)
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(now)
    while was[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = large.join(least, large.u == least.n)
        now = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("n", "m")).distinct().checkpoint()
        new = state(now)
        if new == was:
            break
        was = new
    return now.union(now.select("v", "v").distinct()).toDF("node", "root")
