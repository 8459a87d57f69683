"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node points its larger (``large``) or its smaller neighbours and itself to its least neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is the least node that links reach.

    Repeated links, loops and both directions are fine; a node that only links to itself is left out. An empty table
    gives an empty table. Every step is written to the shared folder, so lineage does not grow; a node with very many
    links is a skewed join that Spark splits, and its least neighbour a partial aggregate.
    """
    links = scratch.keep(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", stay=True)
    for _ in range(rounds):
        n, nodes = links.agg(F.count(F.lit(1)), F.countDistinct("u")).head()
        # done if every node points to one other and none of those points on; v is below u throughout
        if n == nodes and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        with scratch.steps(links.sparkSession):
            links = scratch.keep(_star(_star(links, True), False), "links", stay=True)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
