"""Communities that a task works out are those of the rounds of joins."""

import numpy as np
from pyspark.sql import functions as F

from marginalia.operators import graph, moves, walks


def test_hash_is_that_of_spark(spark):
    ids = [0, 1, -5, 77, 1 << 40, -(1 << 62)]
    df = spark.createDataFrame([(x,) for x in ids], "id long")
    for turn in (0, 1, 15):
        assert [r[0] for r in df.select(F.xxhash64("id", F.lit(turn))).collect()] == moves.hashed(np.array(ids), turn).tolist()


def test_connected_chains():
    n = 5000
    order = np.random.default_rng(2).permutation(n)
    a, b = np.concatenate([order[:-1], order[1:]]), np.concatenate([order[1:], order[:-1]])
    assert (moves.connected(n, a, b) == 0).all() and moves.connected(3, np.array([1, 2]), np.array([2, 1])).tolist() == [0, 1, 1]


def test_tasks_and_rounds_agree(spark, monkeypatch):
    r = np.random.default_rng(8)
    links = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 26, (40, 2)).tolist() if a != b})
    e = spark.createDataFrame(links, "src long, dst long")
    n = graph.nodes_of(e)
    got = {x["id"]: x["community"] for x in graph.modularity_communities(n, e).collect()}
    monkeypatch.setattr(walks, "LOCAL_EDGES", 0)
    assert got == {x["id"]: x["community"] for x in graph.modularity_communities(n, e).collect()}


def test_communities_take_few_jobs(spark):
    """A round of joins for each round of moving makes some hundreds."""
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src % 100 <> 99")
    context = spark.sparkContext
    context.setJobGroup("communities", "communities")
    graph.modularity_communities(graph.nodes_of(e), e).count()
    assert len(context.statusTracker().getJobIdsForGroup("communities")) < 150
    context.setLocalProperty("spark.jobGroup.id", None)
