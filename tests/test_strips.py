"""Blocks that meet are copied for some pairs at a time, with the same pairs as at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import session
from marginalia.operators import overlap, search


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that strips were written to."""
    keep, names = session.keep, []

    def seen(df, name, *a, **k):
        names.append(name)
        return keep(df, name, *a, **k)

    monkeypatch.setattr(session, "keep", seen)
    return names


def test_similar_pairs_in_strips(spark, monkeypatch, written):
    x = np.random.default_rng(5).normal(size=(60, 4))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, embedding array<double>")
    monkeypatch.setattr(search, "STRIP", 1)
    got = {(r["a"], r["b"]) for r in search.similar_pairs(v, 0.8, block=16, pivots=2).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] >= 0.8} and written.count("similar") > 1


def test_overlaps_in_strips(spark, monkeypatch, written):
    r = np.random.default_rng(6)
    sets = {k: {f"w{w}" for w in r.integers(0, 14, 6)} for k in range(40)}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, words array<string>").where(F.size("words") > 0)
    for name, value in (("STRIP", 1), ("SETS", 6)):
        monkeypatch.setattr(overlap, name, value)
    got = {(x["a"], x["b"]): x["overlap"] for x in overlap.overlapping(df, 0.5).collect()}
    each = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == pytest.approx({p: s for p, s in each.items() if s >= 0.5}) and written.count("found") > 1
