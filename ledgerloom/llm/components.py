"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean, materialize, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours v.

    The minimum is aggregated before the shuffle, and written before the join back, which then has
    exchanges of its own: Spark can split it, so a node with very many neighbours is no bottleneck.
    """
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node of its component.

    Each round halves the longest path roughly; the result of each is written to the shared
    folder, so lineage stays short, and the one before it is deleted. The rounds end when a whole
    round changes nothing.
    """
    start = written()
    now = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        small = _with_least(large)
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = materialize(small, "edges")
        clean(edges.sparkSession, start)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges are stars: every node points at the root, roots point at none.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
