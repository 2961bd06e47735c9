"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's (larger or smaller) neighbours move to its least neighbour."""
    if large:
        sided = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sided = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sided.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sided.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, component): each node that occurs in ``links`` and the least node it reaches.

    Every round is a few shuffles keyed by node; counts of hot nodes are combined
    before the shuffle and their rows are joined with skew splitting, so no task
    holds a component. Null ends and self links are ignored.
    """
    edges = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    edges = materialize(edges.filter("a is not null and b is not null and a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        edges = materialize(_stars(_stars(edges, True), False), "stars")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
