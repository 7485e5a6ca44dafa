"""Graph queries without SQL against brute force over small line tables."""

import numpy as np
import pytest

from marginalia.operators import graph
from marginalia.plans.catalog import QUERIES

#: Customers (nation, segment, balance), whose neighbours by balance in nation and segment make LINKS.
CUSTOMERS = [(1, 0, "A", 1.0), (2, 0, "B", 2.0), (3, 0, "A", 3.0), (4, 0, "C", 4.0), (5, 0, "B", 5.0), (6, 0, "B", 6.0), (7, 0, "D", 7.0), (8, 0, "C", 7.0), (21, 1, "A", 1.0), (22, 1, "A", 2.0), (23, 2, "A", 2.0)]
LINKS = [(1, 2), (1, 3), (2, 3), (2, 5), (3, 4), (4, 5), (4, 8), (5, 6), (6, 7), (7, 8), (21, 22)]
#: Parts of the first and second lines of orders 1, 2, ...
ORDERS = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (2, 5), (6, 4), (7, 1), (1, 7), (8, 8), (4, 8), (9, 2), (3, 5, 2, 9, 1)]


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lines")
    rows = [(k, n + 1, part, 1, "N") for k, order in enumerate(ORDERS, 1) for n, part in enumerate(order)]
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def matrix(edges):
    ids = sorted({x for e in edges for x in e})
    m = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        m[ids.index(a), ids.index(b)] = 1
    return ids, m


PARTS = sorted({e for o in ORDERS for e in zip(o, o[1:]) if e[0] != e[1]})


def brute_betweenness(edges):
    ids, m = matrix(edges)
    n = len(ids)
    d, c = np.full((n, n), np.inf), np.zeros((n, n))
    walks = np.eye(n)
    for k in range(n):
        new = (walks > 0) & np.isinf(d)
        d[new], c[new] = k, walks[new]
        walks = walks @ m
    out = {}
    for v in range(n):
        through = [c[s, v] * c[v, t] / c[s, t] for s in range(n) for t in range(n) if len({s, t, v}) == 3 and np.isfinite(d[s, t]) and d[s, v] + d[v, t] == d[s, t]]
        out[ids[v]] = sum(through) / ((n - 1) * (n - 2))
    return out


def test_betweenness_of_all_orders(spark, lines_dir):
    got = {r["id"]: r["betweenness"] for r in QUERIES["g5_betweenness"](spark, lines_dir).collect()}
    assert got == pytest.approx(brute_betweenness(PARTS), abs=1e-6)


def test_katz_of_all_orders(spark, lines_dir):
    ids, m = matrix(PARTS)
    alpha, x = 0.1 / ((m + m.T) > 0).sum(1).max(), np.zeros(len(ids))
    for _ in range(50):
        x = alpha * m.T @ x + 1
    got = {r["id"]: r["score"] for r in QUERIES["g8_katz"](spark, lines_dir).collect()}
    assert got == pytest.approx(dict(zip(ids, x / np.linalg.norm(x))), abs=2e-6)


def test_negatives_of_all_orders(spark, lines_dir):
    ids, taken = {x for e in PARTS for x in e}, {tuple(sorted(e)) for e in PARTS}
    got = [tuple(r) for r in QUERIES["t12_random_negatives"](spark, lines_dir).collect()]
    assert got and len(got) == len(set(got)) and not taken & set(got) and {x for p in got for x in p} <= ids


def test_customer_links(spark, lines_dir):
    from marginalia.plans import base

    assert sorted(tuple(r) for r in base.dense(spark, lines_dir).collect()) == LINKS


def test_communities_of_all_lines(spark, lines_dir):
    for name in ("g15_communities", "g15_label_propagation"):
        assert {r["id"] for r in QUERIES[name](spark, lines_dir).collect()} == {x for e in LINKS for x in e}


def quality_of(labels, links):
    """Modularity of a labelling of an undirected graph."""
    m, k = len(links), {}
    for a, b in links:
        k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
    inside = sum(labels[a] == labels[b] for a, b in links) / m
    return inside - sum((sum(k[x] for x in k if labels[x] == c) / (2 * m)) ** 2 for c in set(labels.values()))


def test_communities_by_modularity(spark):
    groups = [range(0, 6), range(10, 15), range(20, 27)]
    links = [(a, b) for g in groups for a in g for b in g if a < b] + [(0, 10), (14, 20)]
    e = spark.createDataFrame(links, "src long, dst long")
    n = spark.createDataFrame([(x,) for g in groups for x in g] + [(99,)], "id long")
    got = {r["id"]: r["community"] for r in graph.modularity_communities(n, e).collect()}
    assert got == {x: min(g) for g in groups for x in g} | {99: 99}
    r = np.random.default_rng(5)
    links = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 60, (160, 2)).tolist() if a != b})
    e = spark.createDataFrame(links, "src long, dst long")
    got = {r["id"]: r["community"] for r in graph.modularity_communities(graph.nodes_of(e), e).collect()}
    assert quality_of(got, links) > 0.28  # greedy merging reaches about 0.3 on graphs like this


def test_communities_are_connected(spark):
    r = np.random.default_rng(11)
    links = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 70, (110, 2)).tolist() if a != b})
    e = spark.createDataFrame(links, "src long, dst long")
    n = graph.nodes_of(e)
    got = {r["id"]: r["community"] for r in graph.modularity_communities(n, e).collect()}
    near = {}
    for a, b in links:
        if got[a] == got[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(got.values()):
        members = {x for x in got if got[x] == c}
        seen, todo = {c}, [c]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert seen == members and c == min(members)
    plain = {r["id"]: r["community"] for r in graph.modularity_communities(n, e, refined=False).collect()}
    assert quality_of(got, links) >= quality_of(plain, links) - 0.02


def test_disconnected_communities_are_parted(spark):
    """Local moving can leave a community in parts once the node between them has gone to another one."""
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (2, 5), (3, 5), (5, 6), (5, 7), (6, 7)], "src long, dst long")
    labels = spark.createDataFrame([(k, 1) for k in range(5)] + [(k, 5) for k in (5, 6, 7)], "id long, community long")
    got = {r["id"]: r["community"] for r in graph.connected_parts(graph.undirected(e), labels).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5}


def test_sampled_betweenness(spark):
    r = np.random.default_rng(6)
    links = sorted({(a, b) for a, b in r.integers(0, 40, (120, 2)).tolist() if a != b})
    e = spark.createDataFrame(links, "src long, dst long")
    n = graph.nodes_of(e)
    whole = {x["id"]: x["betweenness"] for x in graph.betweenness(e, n).collect()}
    some = {x["id"]: x["betweenness"] for x in graph.betweenness(e, n, sampled_above=10).collect()}
    assert set(some) == set(whole) and 0.2 < sum(some.values()) / sum(whole.values()) < 5


def test_shortest_paths_and_diameter(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 4), (4, 1), (1, 1), (1, 8), (5, 1), (2, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r["shortest_path"] for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {(1, 4): 3, (4, 1): 3, (1, 1): 0, (1, 8): 999, (5, 1): 999, (2, 3): 1}
    assert tuple(graph.diameter(e, graph.nodes_of(e)).first()) == (3, pytest.approx(10 / 6))
    assert tuple(graph.diameter(e, graph.nodes_of(e), most=3).first()) == (None, None)


def test_succession_over_ranges(spark):
    r = np.random.default_rng(7)
    rows = [(int(t), k, int(u)) for k, (t, u) in enumerate(zip(r.integers(0, 300, 500), r.integers(0, 9, 500)))]
    df = spark.createDataFrame(rows, "ts long, event_id long, user_id long").repartition(6)
    users = [u for _, _, u in sorted(rows)]
    assert {tuple(x) for x in graph.succession(df, ["ts", "event_id"], "user_id").collect()} == {(a, b) for a, b in zip(users, users[1:]) if a != b}
    assert graph.succession(df.limit(0), ["ts", "event_id"], "user_id").count() == 0


def test_tag_context_and_reach(spark):
    tagged = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, tag string")
    e = spark.createDataFrame([("a", "q"), ("a", "p"), ("c", "a"), ("p", "z")], "src string, dst string")
    assert {r["id"]: r["linked"] for r in graph.tag_context(tagged, e, "x").collect()} == {"a": ["p", "q"], "b": []}
    assert {tuple(r) for r in graph.reachable(e, "c", 2).collect()} == {("a", 1), ("p", 2), ("q", 2)}


def test_eigenvector_has_converged(spark, lines_dir):
    ids, m = matrix(PARTS)
    x = np.abs(np.linalg.eigh(((m + m.T) > 0).astype(float))[1][:, -1])
    got = {r["id"]: r["score"] for r in QUERIES["g7_eigenvector"](spark, lines_dir).collect()}
    assert got == pytest.approx(dict(zip(ids, x)), abs=2e-6)


def test_communities_run_ten_rounds(spark, tmp_path):
    links = [(k, k + 1) for k in range(1, 24)]
    rows = [(k, 0, f"s{k}", float(k)) for k in range(1, 25)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    near = {k: [x for e in links for x in e if k in e and x != k] for k in range(1, 25)}

    def propagated(rounds):
        labels = {k: k for k in near}
        for _ in range(rounds):
            votes = {k: [labels[x] for x in [*near[k], k]] for k in near}
            labels = {k: min(v, key=lambda c: (-v.count(c), c)) for k, v in votes.items()}
        return labels

    assert propagated(5) != propagated(10)
    assert {r["id"]: r["community"] for r in QUERIES["g15_label_propagation"](spark, str(tmp_path)).collect()} == propagated(10)


def test_bridges_use_communities_and_betweenness(spark, lines_dir):
    between = brute_betweenness([*LINKS, *[(b, a) for a, b in LINKS]])
    near = {k: {x for e in LINKS for x in e if k in e and x != k} for k in between}
    labels = {r["id"]: r["community"] for r in QUERIES["g15_communities"](spark, lines_dir).collect()}
    got = {r["id"]: r for r in QUERIES["g17_bridges"](spark, lines_dir).collect()}
    assert set(got) == set(near)
    for k, around in near.items():
        far = [labels[x] for x in around if labels[x] != labels[k]]
        links = sum(y in near[x] for x in around for y in around if x < y)
        size = len(around) - links / len(around) if len(around) > 1 else 1
        score = 0.3 * len(far) / len(around) + 0.2 * min(1, len(set(far)) / 3) + 0.3 * between[k] + 0.2 * min(1, size / 5)
        assert (got[k]["inter"], got[k]["communities"]) == (len(far), len(set(far)))
        assert got[k]["bridge_score"] == pytest.approx(score, abs=2e-6)
        assert got[k]["is_bridge"] == (score > 0.25 and bool(far) and len(far) / len(around) >= 0.1)


def test_triangles_without_hub_squares(spark):
    """A star with a ring around it: closed wedges grow with edges, though the hub has all pairs of neighbours."""
    n = 400
    e = spark.createDataFrame([(0, k) for k in range(1, n + 1)] + [(k, k % n + 1) for k in range(1, n + 1)], "src long, dst long")
    closed, _ = graph.closed_wedges(e)
    assert closed.count() == n
    got = {r["id"]: (r["degree"], r["links"]) for r in graph.triangles(e).collect()}
    assert got == {0: (n, n)} | {k: (3, 2) for k in range(1, n + 1)}
    c = {r["id"]: r["constraint"] for r in graph.constraint(e).collect()}
    one = ((1 + 2 / 3) / n) ** 2 * n  # of the hub: each neighbour and the two beside it
    ring = (1 / 3 * (1 + 1 / 3 + 1 / 3)) ** 2 + 2 * (1 / 3 * (1 + 1 / n)) ** 2
    assert c[0] == pytest.approx(one) and c[5] == pytest.approx(ring)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (1, 9)], "a long, b long")
    got = {(r["a"], r["b"]): r["common"] for r in graph.common_neighbours(e, pairs).collect()}
    assert got == {(0, 1): 2, (1, 2): 1, (1, 3): 2, (1, 9): 1}


def test_loops_leave_one_table(spark, tmp_path, monkeypatch):
    from marginalia import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    n = graph.nodes_of(e)
    for f in (lambda: graph.pagerank(n, e), lambda: graph.distances(e, n), lambda: graph.betweenness(e, n), lambda: graph.modularity_communities(n, e), lambda: graph.triangles(e)):
        before = len(list(tmp_path.iterdir()))
        f().collect()
        assert len(list(tmp_path.iterdir())) == before + 1
    with session.scratch():
        graph.katz(n, e).collect()
    assert len(list(tmp_path.iterdir())) == before + 1


def test_estimated_path_metrics(spark):
    r = np.random.default_rng(13)
    links = sorted({(a, b) for a, b in r.integers(0, 120, (260, 2)).tolist() if a != b})
    e = spark.createDataFrame([*links, (500, 501)], "src long, dst long")
    n = graph.nodes_of(e).union(spark.createDataFrame([(900,)], "id long"))
    exact = {x["id"]: x for x in graph.path_metrics(e, n).collect()}
    got = {x["id"]: x for x in graph.estimated_path_metrics(e, n, 14).collect()}
    assert set(got) == set(exact)
    for k, x in exact.items():
        assert abs(got[k]["reached"] - x["reached"]) <= 0.03 * x["reached"] + 0.5
        assert got[k]["closeness"] == pytest.approx(x["closeness"], rel=0.1, abs=1e-6) and got[k]["harmonic"] == pytest.approx(x["harmonic"], rel=0.06, abs=1e-6)
    assert np.mean([got[k]["eccentricity"] == x["eccentricity"] for k, x in exact.items()]) > 0.9


def test_sketches_are_near_the_exact_metrics(spark, lines_dir):
    from marginalia.plans import base

    e = base.sparse(spark, lines_dir)
    exact = {x["id"]: x["closeness"] for x in graph.path_metrics(e, graph.nodes_of(e)).collect()}
    got = {x["id"]: x["closeness"] for x in QUERIES["g6_g9_g13_estimated"](spark, lines_dir).collect()}
    assert got == pytest.approx(exact, rel=0.02, abs=1e-5)
