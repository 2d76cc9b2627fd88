"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import lookup, staged

ROUNDS = 60


def _star(edges: DataFrame, both: bool, total: int) -> DataFrame:
    """Edges (a > b). Large star (both): larger neighbours go to the least of all; small star: smaller ones."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    met = lookup(pairs, least, "a", "n", total * (2 if both else 1), "inner").withColumn("m", F.least("a", "m"))
    moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if both else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")


def nearer(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, root) after so many rounds: nodes of one root are linked, but linked nodes may still differ."""
    now = _oriented(edges)
    for _ in range(rounds):
        large = staged(_star(now, True, now.count()), "large")
        now = staged(_star(large, False, large.count()), "small")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the least node that it is linked to."""
    now = _oriented(edges)
    before = None
    for _ in range(ROUNDS):
        # equal sums of two independent 64-bit hashes, without overflow, mean equal sets of edges
        sums = [F.sum(F.xxhash64(*x).cast("decimal(20,0)")) for x in (("a", "b"), (F.lit(1), "b", "a"))]
        mark = now.agg(F.count("*"), *sums).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        large = staged(_star(now, True, mark[0]), "large")
        now = staged(_star(large, False, large.count()), "small")
    raise RuntimeError("components: no fixed point")
