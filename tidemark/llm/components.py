"""Connected components of a graph held as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp, its component's smallest node, for every node of the edges a, b (whole
    numbers; loops and repeats do no harm). Each round is written to the shared folder."""
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        now = scratch(_small_star(_large_star(now)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, comp) after further edges a, b: only the graph of components that these
    link is worked on, so what is known already costs one join."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    found = edges.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    found = scratch(found, "found")
    moved = components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    nodes = found.select(F.col("a").alias("node"), F.col("x").alias("comp")).unionByName(found.select(F.col("b").alias("node"), F.col("y").alias("comp")))
    return scratch(labels.unionByName(nodes).distinct().join(moved, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")
