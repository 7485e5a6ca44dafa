"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import discard, keep


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the edges (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds: each hooks every neighbour to
    the least id near it, so the number of edges never grows and chains shrink
    by half a round. Edges stay in tables; the driver sees two numbers a round.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges, before = keep(small.where("a <> b").distinct(), "edges"), edges
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components have not settled")
    ids = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    return ids.join(edges.groupBy("a").agg(F.min("b").alias("m")).hint("merge"), "a", "left").select(F.col("a").alias("id"), F.coalesce("m", "a").alias("component"))
