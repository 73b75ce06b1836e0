"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step replaces a node's links with links to the least node it knows, so the graph
shrinks to one star per component in a logarithmic number of rounds.  Edges are written
to the shared folder each round; nothing but two totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    joined = down.join(least, "u")
    out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node u of edges (u, v: bigint) but the roots themselves; the root is the least node of the component."""
    now = written(edges.filter("u <> v").distinct(), "edges")
    total = None
    while True:
        new = written(_small(_large(now)), "edges")
        drop_written(now)
        now = new
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if total == (row.n, row.s):
            return now.select("u", F.col("v").alias("root"))
        total = (row.n, row.s)
