"""Searches inside components, work of loops that is done once, and joins of loops that nothing is broadcast for."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph, walks


def some_edges(spark, n=14, m=20, seed=1):
    draw = np.random.default_rng(seed).integers(0, n, (m, 2)).tolist()
    chain = [[100 + k, 101 + k] for k in range(7)]
    rows = sorted({(a, b) for a, b in draw + chain if a != b})
    return rows, spark.createDataFrame(rows, "src long, dst long")


def brute(rows, source):
    out, front, d = {source: 0}, {source}, 0
    while front:
        d += 1
        front = {b for a, b in rows if a in front} - set(out)
        out |= dict.fromkeys(front, d)
    return out


@pytest.fixture(params=["tasks", "rounds", "blocks"])
def place(request, monkeypatch):
    """Components searched in tasks, all by rounds, or in tasks by blocks of one source and several shares."""
    if request.param == "rounds":
        monkeypatch.setattr(walks, "LOCAL_EDGES", 0)
    if request.param == "blocks":
        monkeypatch.setattr(walks, "CELLS", 1)
        monkeypatch.setattr(walks, "WORK", 60)
    return request.param


def test_path_metrics_anywhere(spark, place):
    rows, e = some_edges(spark)
    ids = sorted({x for r in rows for x in r})
    into = {t: [d for s in ids for i, d in brute(rows, s).items() if i == t and d] for t in ids}
    got = {r["id"]: r for r in graph.path_metrics(e, graph.nodes_of(e)).collect()}
    assert set(got) == set(ids)
    for t, ds in into.items():
        want = (len(ds) / sum(ds) * len(ds) / (len(ids) - 1) if ds else 0, sum(1 / d for d in ds), max(ds, default=0), len(ds))
        assert tuple(got[t])[1:] == pytest.approx(want)


def test_shortest_paths_anywhere(spark, place):
    rows, e = some_edges(spark)
    both = rows + [(b, a) for a, b in rows]
    asked = [(a, b) for a in (0, 1, 2, 3, 100, 107, 999) for b in (0, 1, 5, 9, 13, 101, 106, 998, 999)]
    for most in (None, 3):
        got = {(r["a"], r["b"]): r["shortest_path"] for r in graph.shortest_paths(e, spark.createDataFrame(asked, "a long, b long"), most=most).collect()}
        want = {(a, b): brute(both, a).get(b, 999) for a, b in asked}
        assert got == {p: d if most is None or d <= most else 999 for p, d in want.items()}


def test_betweenness_anywhere(spark, place, monkeypatch):
    rows, e = some_edges(spark)
    few = {r["id"]: r["betweenness"] for r in graph.betweenness(e, graph.nodes_of(e)).collect()}
    monkeypatch.setattr(graph, "FEW", -1)
    assert few == pytest.approx({r["id"]: r["betweenness"] for r in graph.betweenness(e, graph.nodes_of(e)).collect()})


def test_long_chains_take_few_jobs(spark):
    e = spark.range(800).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src % 400 <> 399")
    context = spark.sparkContext
    context.setJobGroup("chains", "chains")
    graph.path_metrics(e, graph.nodes_of(e)).count()
    assert len(context.statusTracker().getJobIdsForGroup("chains")) < 300  # a round of joins for each step makes over 400
    context.setLocalProperty("spark.jobGroup.id", None)


def test_edges_of_loops_are_made_once(spark):
    for run in (graph.katz, lambda n, e: graph.eigenvector(n, e, 5), lambda n, e: graph.betweenness(e.unionByName(e), n)):
        made = spark.sparkContext.accumulator(0)

        def passed(batches, made=made):
            for b in batches:
                made.add(b.num_rows)
                yield b

        rows = [(a, b) for a in range(12) for b in range(12) if a != b]
        nodes = spark.range(12).select("id")
        e = spark.createDataFrame(rows, "src long, dst long").mapInArrow(passed, "src long, dst long")
        run(nodes, e).collect()
        assert made.value <= 2 * len(rows)


def test_katz_stops_where_nothing_moves(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "src long, dst long")
    scores = [sorted(tuple(r) for r in graph.katz(graph.nodes_of(e), e, rounds).collect()) for rounds in (30, 300)]
    assert np.allclose(scores[0], scores[1], rtol=1e-14, atol=0)


def test_wedges_hold_ids_alone(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    closed, *_ = graph.closed_wedges(e)
    assert closed.columns and set(closed.columns) == {"u", "v", "w"} and closed.count() == 1


def test_walk_numbers_any_ids():
    edges = pa.table({"src": ["x", "y"], "dst": ["y", "z"]})
    walk = walks.Walk(edges, [pa.chunked_array([["x", "z"]])])
    assert walk.between(walk.codes[0], walk.codes[0][::-1], None).tolist() == [2, -1]
