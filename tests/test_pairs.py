"""Draws of negative pairs and the cap of pairs per note, against one-after-the-other versions."""

import hashlib
import random
from collections import Counter

import pytest

from marginalia.operators import domains, pairs

MEMBERS = [(g, i) for g, ids in (("x", range(10)), ("y", range(5, 9)), ("z", [1])) for i in ids]


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(MEMBERS, "group string, id long")


def possible(taken):
    inside = {g: [i for q, i in MEMBERS if q == g] for g, _ in MEMBERS}
    return {(a, b) for ids in inside.values() for a in ids for b in ids if a < b} - set(taken)


@pytest.mark.parametrize("m", [2, 3, 4, 5, 8, 11, 30])
def test_permutations_of_pairs(spark, m):
    from pyspark.sql import functions as F

    n = m * (m - 1) // 2
    df = spark.range(n).withColumn("m", F.lit(m).cast("long"))
    orders = []
    for key in ("1|a", "1|b"):
        rows = pairs.unranked(pairs.permuted(df, "id", "m", F.lit(key), "p"), "p").orderBy("id").collect()
        orders.append([(r["i"], r["j"]) for r in rows])
        assert sorted(orders[-1]) == sorted((i, j) for j in range(m) for i in range(j))
    assert m < 5 or orders[0] != orders[1]


@pytest.mark.parametrize("n", [0, 1, 7, 43, 44, 100])
def test_drawn_exactly(spark, members, n):
    taken = [(0, 1), (5, 6)]
    got = [tuple(r) for r in pairs.drawn(members, spark.createDataFrame(taken, "a long, b long"), n).collect()]
    assert len(got) == len(set(got)) == min(n, len(possible(taken))) and set(got) <= possible(taken)


def test_groups_take_turns_and_pairs_are_equally_likely(spark, members):
    none, seen, both = spark.createDataFrame([], "a long, b long"), Counter(), Counter()
    for seed in range(30):
        got = [tuple(r) for r in pairs.drawn(members, none, 6, seed).collect()]
        seen.update(got)
        both["y"] += sum(5 <= a and b <= 8 for a, b in got)
    # Three turns of each group; y has six pairs, x 45, of which six are those of y.
    assert 30 * 3 <= both["y"] <= 30 * 3 + 40
    assert all(seen[p] > 5 for p in possible([]) if 5 <= p[0] and p[1] <= 8)
    assert len([p for p in possible([]) if seen[p]]) > 35


def test_random_and_stratified(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "id long")
    taken = spark.createDataFrame([(0, 1), (2, 1)], "a long, b long")
    got = {tuple(r) for r in pairs.random_negatives(nodes, taken, 50).collect()}
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6)} - {(0, 1), (1, 2)}
    folders = spark.createDataFrame([("f", 0), ("f", 2), ("f", 3), ("g", 4), ("g", 5)], "group string, id long")
    tags = spark.createDataFrame([("t", 0), ("t", 4), ("u", 3)], "group string, id long")
    rows = [tuple(r) for r in pairs.stratified_negatives(nodes, folders, tags, taken, 9).collect()]
    assert len(rows) == len(set(rows)) == 9 and not {(0, 1), (1, 2)} & set(rows)
    assert len({(0, 2), (0, 3), (2, 3), (4, 5)} & set(rows)) >= 3 and (0, 4) in rows
    assert pairs.drawn(folders.limit(0), taken, 5).count() == 0


def one_pass(links, most):
    count, out = Counter(), []
    for a, b in sorted(links, key=lambda p: (hashlib.md5(f"42|{p[0]}|{p[1]}".encode()).hexdigest(), p)):
        if count[a] < most and count[b] < most:
            out.append((a, b))
            count.update((a, b))
    return sorted(out)


@pytest.mark.parametrize("n,k,most", [(30, 200, 3), (8, 28, 2), (40, 100, 1), (60, 60, 5)])
def test_capped_like_one_pass(spark, n, k, most):
    r = random.Random(n)
    links = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(k)} | {(0, x) for x in range(1, n)})
    df = spark.createDataFrame([(a, b, f"{a}-{b}", None) for a, b in links], "a long, b long, label string, at long")
    got = pairs.capped(df, most).collect()
    assert sorted((x["a"], x["b"]) for x in got) == one_pass(links, most) and all(x["label"] == f"{x['a']}-{x['b']}" for x in got)
    assert pairs.capped(df.limit(0), most).columns == df.columns


def test_bridge_opportunities(spark):
    rows = [("a", 9, ["x", "y", "z", "w"]), ("b", 8, ["x", "y", "q"]), ("c", 1, ["k"])]
    got = domains.bridge_opportunities(spark.createDataFrame(rows, "domain string, n long, keywords array<string>")).collect()
    assert [(r["d1"], r["d2"], r["shared"], r["priority"]) for r in got] == [("a", "b", ["x", "y"], "medium")]
    assert got[0]["similarity"] == pytest.approx(2 / 5) and got[0]["rationale"] == "shared words: x, y"
