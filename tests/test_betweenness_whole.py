"""Betweenness counts the paths of every node, at any number of nodes."""

import numpy as np
import pyarrow as pa
import pytest

from marginalia.operators import graph, walks


def chains(n):
    """Betweenness of a chain of n nodes, searched in both directions, over all of two of them."""
    return [2 * k * (n - 1 - k) / ((2 * n - 1) * (2 * n - 2)) for k in range(n)]


def test_above_a_thousand_nodes(spark):
    n = 600
    rows = [(c * n + k, c * n + k + 1) for c in range(2) for k in range(n - 1)]
    e = spark.createDataFrame(rows + [(b, a) for a, b in rows], "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(e, graph.nodes_of(e)).collect()}
    assert got == pytest.approx({c * n + k: x for c in range(2) for k, x in enumerate(chains(n))})


def test_rounds_take_some_sources_at_a_time(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = sorted({(a, b) for a, b in r.integers(0, 12, (40, 2)).tolist() if a != b})
    e = spark.createDataFrame(rows, "src long, dst long")
    want = {x["id"]: x["betweenness"] for x in graph.betweenness(e, graph.nodes_of(e)).collect()}
    monkeypatch.setattr(walks, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graph, "ROUND_ROWS", 50)
    assert {x["id"]: x["betweenness"] for x in graph.betweenness(e, graph.nodes_of(e)).collect()} == pytest.approx(want)


def test_steps_by_rows_and_by_cells(monkeypatch):
    r = np.random.default_rng(4)
    rows = r.integers(0, 60, (700, 2))
    walk = walks.Walk(pa.table({"src": rows[:, 0], "dst": rows[:, 1]}), [pa.chunked_array([np.arange(60)])])
    want = walk.dependencies(walk.codes[0])
    assert walk.dependencies(walk.codes[0], thick=True) == pytest.approx(want)
    monkeypatch.setattr(walks, "PASS", 64)
    monkeypatch.setattr(walks, "CELLS", 16 * 60 * 7)
    assert walk.dependencies(walk.codes[0]) == pytest.approx(want) and walk.dependencies(walk.codes[0], thick=True) == pytest.approx(want)
