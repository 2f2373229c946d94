"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a shuffle over the links; no group is gathered: a node's smallest neighbour comes
from a pre-aggregated minimum. Each round is checkpointed in the shared folder, and the rounds
end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import checkpointed


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Rows have a > b."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with links; links: two columns of one comparable type.

    component is the smallest node that can be reached. No links give an empty table.
    """
    a, b = links.columns
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = checkpointed(e)
    before = None
    for _ in range(rounds):
        e = checkpointed(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
