"""Nearest vectors on rows unlike the sample that a factor could be tuned on."""

import numpy as np
import pytest

from marginalia.llm import vptree


def grouped(kind):
    r = np.random.default_rng(3)
    if kind == "copies":  # groups of copies larger than k, lengths apart
        base = r.standard_normal((40, 64))
        v = np.repeat(base, 30, axis=0) * np.exp2(r.integers(-3, 4, 1200))[:, None]
    elif kind == "growing":  # far apart where ids are small, close groups among the rest
        v = r.standard_normal((3000, 64))
        v[1500:] = v[r.integers(0, 40, 1500)] + 0.05 * r.standard_normal((1500, 64))
    else:  # few dimensions inside many
        v = r.standard_normal((3000, 3)) @ r.standard_normal((3, 64)) + 0.01 * r.standard_normal((3000, 64))
    return r.permutation(v) if kind == "copies" else v


@pytest.mark.parametrize("kind", ["copies", "growing", "flat"])
def test_all_nearest_are_found(spark, kind, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 700)
    monkeypatch.setattr(vptree, "SAMPLE", 200)
    v = grouped(kind)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = {}
    norm = np.sqrt((v * v).sum(axis=1))
    for i in range(0, len(v), 50):
        s = np.round((v @ v[i]) / (norm * norm[i]), 10)
        order = [j for j in np.lexsort((np.arange(len(v)), -s)).tolist() if j != i][:5]
        want[i] = order
    got = {}
    for row in sorted(vptree.nearest(df, df.where("vec_id % 50 = 0"), 5).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert got == want
