"""The similarity join against all pairs, and how much of them it multiplies."""

import numpy as np
import pytest

from marginalia.operators import search


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)


def clustered(seed, n, dim, groups, spread):
    r = np.random.default_rng(seed)
    base = r.normal(size=(groups, dim))
    return (base[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize("threshold,block", [(0.7, 40), (0.95, 16), (0.2, 4096), (-1.0, 64)])
def test_same_pairs_as_all(spark, threshold, block):
    x = clustered(3, 150, 12, 8, 0.3)
    rows = [(k, v) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [1.0, 2.0]), (903, [2.0, 4.0]), (904, []), (905, x[0]), (906, [3 * y for y in x[0]])]
    u = np.asarray([v for _, v in rows if v and len(v) == 12 and any(v)])
    ids = [k for k, v in rows if v and len(v) == 12 and any(v)]
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    s = u @ u.T
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])): s[i, j] for i in range(len(ids)) for j in range(i) if s[i, j] >= threshold}
    want[902, 903] = 1.0
    got = [(r["a"], r["b"], r["similarity"]) for r in search.similar_pairs(table(spark, rows), threshold, block=block, pivots=8).collect()]
    close = {p for p, v in want.items() if abs(v - threshold) < 1e-9}
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} - close == set(want) - close
    assert all(v == pytest.approx(want[a, b], abs=1e-9) for a, b, v in got if (a, b) in want)
    assert search.similar_pairs(table(spark, rows).limit(0), threshold).count() == 0


def test_fewer_products_than_all(spark, sf_dir):
    """On the given vectors, which have no clusters, three quarters at most of what all pairs take."""
    x = np.asarray([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    at, to, value, multiplied = search.products(x, x, 0.7)
    s = x @ x.T
    assert {(i, j) for i, j in zip(at.tolist(), to.tolist())} == {(i, j) for i, j in zip(*(y.tolist() for y in np.nonzero(s >= 0.7)))}
    assert multiplied < 0.75 * x.shape[0] ** 2 * x.shape[1]


def test_blocks_of_clusters_do_not_meet(spark):
    """Ranges of angles to the pivots keep most blocks of a clustered table apart."""
    x = np.asarray(clustered(4, 600, 16, 12, 0.02))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    pivots = x[:24]
    cell = np.argmax(x @ pivots.T, axis=1)
    bounds = [(a.min(axis=0), a.max(axis=0)) for a in (search.angles(x[cell == c], pivots) for c in np.unique(cell))]
    far = np.arccos(0.95)
    meet = sum(not ((la - hb > far).any() or (lb - ha > far).any()) for i, (la, ha) in enumerate(bounds) for lb, hb in bounds[i:])
    assert meet < 0.4 * len(bounds) * (len(bounds) + 1) / 2
