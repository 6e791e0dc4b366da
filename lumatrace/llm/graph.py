"""Connected components of an edge table, by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import materialize


def _half_step(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: each node sends its smallest neighbour to its larger ones. Small star: to its smaller ones and itself."""
    if small:
        own = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    else:
        own = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("u", "v")
    least = own.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = own.join(least, "u")
    if small:
        out = out.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    else:
        out = out.filter(F.col("v") > F.col("u")).select("v", "m")
    return out.filter(F.col("v") != F.col("m")).toDF("src", "dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst) -> (node, component): the smallest id that each linked node can reach. Nodes without links are absent.

    Alternating large-star and small-star rounds, until each node has one label (stars, which a round would leave as they
    are; edges that are stars from the start take no round). Each round is written to the shared folder, so lineage stays
    short. A node with very many links only takes part in a minimum (combined before the shuffle) and in a join that
    adaptive execution can split.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = materialize(edges.filter(F.col("src") != F.col("dst")).distinct(), "cc")
    while True:
        labels = edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(edges.select("dst", "dst"))
        if not labels.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").limit(1).count():
            return labels.distinct()
        edges = materialize(_half_step(_half_step(edges, small=False), small=True), "cc")
