"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (partial aggregation) and a join on the node;
no neighbour list is ever gathered, so a hub with a third of all links only
makes a skewed join, which Spark splits. Rounds grow with the logarithm of the
longest chain. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.common import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (a, root) for every node that isn't its component's least node.

    Links of a node with itself and null ends are left out; no links give no rows.
    """
    stars = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            return stars.select("a", F.col("b").alias("root"))
        seen = state
        before, stars = stars, written(_small_star(_large_star(stars)), "links")
        discard(before)
