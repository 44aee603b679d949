"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is two
aggregations (combined before the shuffle) and two joins; nothing is collected but a row count and
a checksum. Each round is written to the shared folder, so lineage stays one round long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.shared import discard, materialize

MAX_ROUNDS = 60


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the least node.

    Loops, repeated edges and edges with a null end change nothing. An empty table gives an empty one.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"), F.col(src).alias("s"), F.col(dst).alias("d"))
        .where("s is not null and d is not null and a <> b")
        .select("a", "b")
        .distinct()
    )
    e = materialize(e, "edges")
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, materialize(small.unionByName(roots.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(last)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
