"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshape.plans.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (x, y) of any ordered type; a label is the smallest node of its component.

    Steps alternate until the edges are stars, which takes about the logarithm of the longest path; edges that are stars to begin with
    need none. Each step is a table in the shared folder. Loops and repeated edges are allowed, nulls are left out."""
    pairs = written(edges.where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    while not _stars(pairs):
        # large star: link the larger neighbours of a node to the smallest of all
        both = pairs.select("x", "y").unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = written(both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "large-star")
        # small star: link the smaller neighbours of a node, and itself, to the smallest of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        pairs = written(moved.unionAll(low.select("x", F.col("m").alias("y"))).distinct(), "small-star")
    return pairs.select(F.col("x").alias("node"), F.col("y").alias("label")).unionAll(pairs.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def _stars(pairs: DataFrame) -> bool:
    """Whether each x has one y, and no y is an x."""
    ends = pairs.select(F.col("x").alias("node"), F.col("y").alias("to")).unionAll(pairs.select(F.col("y").alias("node"), F.lit(None).alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count("to").alias("out"), F.count("*").alias("n"))
    return seen.where("low <> high or (out > 0 and out < n)").isEmpty()
