"""Bridges weigh betweenness over the paths of every customer."""

import pytest

from marginalia.plans.catalog import QUERIES


def chains(n):
    """Betweenness of a chain of n nodes, searched in both directions, over all of two of them."""
    return [2 * k * (n - 1 - k) / ((2 * n - 1) * (2 * n - 2)) for k in range(n)]


def test_bridges_above_a_thousand_customers(spark, tmp_path):
    n = 600
    rows = [(c * n + k, c, f"s{k}", float(k)) for c in range(2) for k in range(n)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["id"]: r for r in QUERIES["g17_bridges"](spark, str(tmp_path)).collect()}
    for c in range(2):
        for k, x in enumerate(chains(n)):
            r = got[c * n + k]
            degree = 1 if k in (0, n - 1) else 2
            assert r["bridge_score"] == pytest.approx(0.3 * r["ratio"] + 0.2 * min(1, r["communities"] / 3) + 0.3 * x + 0.2 * degree / 5, abs=2e-6)
