"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfeatures.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reached) for every node of ``edges`` (a, b: bigint).

    Alternates large-star and small-star steps: each keeps the components and moves edges
    to lesser neighbours, until every edge joins a node with its component's least node.
    A step is a few aggregations with map-side combine; no neighbour list is gathered.
    Self loops and repeated edges are allowed; rows with a null end are ignored. Each
    step's edges are checkpointed, so lost executors cost one step at most."""
    links = materialize(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    nodes = links.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    links = links.where("hi <> lo")
    before = None
    while True:
        links = materialize(_small_star(_large_star(links)))
        n, signature = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if (n, signature) == before:
            break
        before = (n, signature)
    return nodes.join(links.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Each greater neighbour of u links to the least node around u."""
    both = _both_ways(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its lesser neighbours link to the least of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    own = least.select("hi", F.col("m").alias("lo"))
    return moved.union(own).distinct()
