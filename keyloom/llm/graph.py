"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations and joins on the link table and is written to the checkpoint
folder, that before it removed; the links shrink to stars around the least node of each component, in about as many rounds as
the logarithm of the longest path.  No neighbourhood is ever gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop

#: Links to a partition between rounds.
LINKS = 500_000


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    up = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long, in any order).  node, root for every node that is not the least of its component."""
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        written = cut(_small(_large(now)))
        if before is not None:
            drop(before)
        before, count = written, written.count()
        now = written.coalesce(count // LINKS + 1)
        lone = now.select("u").distinct().count() == count  # one root each
        if lone and now.join(now.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():  # and roots have none
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
