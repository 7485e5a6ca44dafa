"""Graphs as edge tables (src, dst): degrees, centralities, paths, components, communities.

Loops are joins over tables that are written between rounds, so lineage stays
short and a lost executor repeats one round at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import moves, walks
from marginalia.operators.components import connected_components
from marginalia.operators.walks import Walk
from marginalia.session import discard, keep, tidied


def link_graph(edges: DataFrame) -> DataFrame:
    """One row per (src, dst) without self loops; of parallel edges the one with the greatest attributes stays."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.where("src <> dst")
    if not rest:
        return out.distinct()
    return out.groupBy("src", "dst").agg(F.max(F.struct(*rest)).alias("_a")).select("src", "dst", "_a.*")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each connected pair once, without self loops."""
    out = edges.where("src <> dst").select("src", "dst")
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree and degree centrality (in + out) / (n - 1), 0 for nodes without edges."""
    ins, outs = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")), edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    out = nodes.join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    n = F.broadcast(nodes.agg(F.count("*").alias("_n")))  # one row
    return out.join(n).withColumn("centrality", F.when(F.col("_n") > 1, (F.col("in_degree") + F.col("out_degree")) / (F.col("_n") - 1)).otherwise(0.0)).drop("_n")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density, degree centralisation, number of components and size of the largest one of a directed graph."""
    parts = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    d = degrees(nodes, edges)
    a = d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.max(F.col("in_degree") + F.col("out_degree")).alias("_m"), F.sum(F.col("in_degree") + F.col("out_degree")).alias("_s"))
    n = F.col("nodes")
    return a.select("nodes", "edges", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 2, (n * F.col("_m") - F.col("_s")) / ((n - 1) * (n - 2))).otherwise(0.0).alias("centralization")).join(F.broadcast(parts))  # one row each


@contextmanager
def held(edges: DataFrame, key: str) -> Iterator[DataFrame]:
    """Edges (src, dst) worked out once, and held on executors' disks dealt by a key for as long as the block: joins of a loop on it send the other side only."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(edges.select("src", "dst"), "edges").repartition(parts, key).persist(StorageLevel.DISK_ONLY)
    try:
        yield dealt
    finally:
        dealt.unpersist()


@tidied("pagerank")
def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """id, rank: power iteration; the mass of nodes without out-edges is spread evenly. With a tolerance it ends once the change is below n times it."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    weighted = keep(edges.join(out, "src").select("src", "dst", (1.0 / F.col("k")).alias("w")), "weights")
    ranks = keep(nodes.join(out, nodes["id"] == out["src"], "left").select("id", F.col("k").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0))).first()[0] or 0.0
        inflow = weighted.join(ranks, weighted["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("flow"))
        new = ranks.join(inflow, ranks["id"] == inflow["dst"], "left").select("id", "dangling", F.col("rank").alias("before"), (F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        new = keep(new, "ranks")
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
        ranks = new.drop("before")
        if tolerance is not None and change < n * tolerance:
            break
    return ranks.select("id", "rank")


@tidied("eigenvector")
def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 50, tolerance: float | None = None) -> DataFrame:
    """id, score: power iteration of x + A'x on in-edges, normalised to length one. With a tolerance it ends once the change is below n times it."""
    scores = keep(nodes.select("id"), "scores")
    n = scores.count()
    scores = scores.withColumn("score", F.lit(1.0 / max(1, n)))
    with held(edges, "src") as dealt:
        for _ in range(rounds if n else 0):
            flow = dealt.join(scores, dealt["src"] == scores["id"]).groupBy("dst").agg(F.sum("score").alias("flow"))
            new = keep(scores.join(flow, scores["id"] == flow["dst"], "left").select("id", (F.col("score") + F.coalesce("flow", F.lit(0.0))).alias("score"), F.col("score").alias("before")), "scores")
            length = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
            moved = new.withColumn("score", F.col("score") / length)
            scores = moved.select("id", "score")
            if tolerance is not None and moved.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < n * tolerance:
                break
    return scores


@tidied("katz")
def katz(nodes: DataFrame, edges: DataFrame, rounds: int = 30, beta: float = 1.0) -> DataFrame:
    """id, score: alpha is a tenth of the inverse of the greatest degree; normalised to length one.

    No node has more in-edges than that degree, so a round changes scores by a
    tenth of what the last one did at most. Rounds end before their number
    where the rest of them together could move no score by more than about
    1e-15 of itself, which is what doubles tell apart.
    """
    with held(edges, "src") as dealt:
        top = undirected(dealt).groupBy("src").count().agg(F.max("count")).first()[0] or 1
        alpha = 0.1 / top
        scores = keep(nodes.select("id", F.lit(0.0).alias("score")), "scores")
        for _ in range(rounds):
            flow = dealt.join(scores, dealt["src"] == scores["id"]).groupBy("dst").agg(F.sum("score").alias("flow"))
            new = keep(scores.join(flow, scores["id"] == flow["dst"], "left").select("id", (alpha * F.coalesce("flow", F.lit(0.0)) + beta).alias("score"), F.col("score").alias("before")), "scores")
            change = new.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0
            scores = new.select("id", "score")
            if change <= 1e-14 * abs(beta):
                break
    length = scores.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
    return scores.select("id", (F.col("score") / length).alias("score"))


def closed_wedges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triangles u, v, w, each once; id and degree of all nodes) of the undirected graph.

    Each edge points to its end of higher degree (ties by id), so a hub of any
    degree makes few wedges. A wedge goes round as its three ids alone.
    """
    return _closed(keep(undirected(edges), "both"))


def _closed(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """closed_wedges of both directions of the edges."""
    degree = keep(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "degrees")
    a, b = degree.select(F.col("id").alias("src"), F.col("degree").alias("_a")), degree.select(F.col("id").alias("dst"), F.col("degree").alias("_b"))
    ranked = both.where("src < dst").join(a, "src").join(b, "dst")
    first = (F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("src") < F.col("dst")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    arcs = keep(ranked.select(pick("src", "dst").alias("u"), pick("dst", "src").alias("v"), pick("_b", "_a").alias("kv")), "arcs")
    wedges = arcs.alias("x").join(arcs.alias("y"), F.expr("x.u = y.u and (x.kv, x.v) < (y.kv, y.v)")).select("x.u", "x.v", F.col("y.v").alias("w"))
    return wedges.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"]), degree


@tidied("triangles")
def triangles(edges: DataFrame) -> DataFrame:
    """id, degree, links (pairs of neighbours that are connected) of the undirected graph."""
    closed, degree = closed_wedges(edges)
    each = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return degree.join(each, "id", "left").na.fill(0, ["links"])


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, links, coefficient, effective_size (degree less links over degree)."""
    k = F.col("degree")
    return triangles(edges).withColumn("coefficient", F.when(k > 1, 2.0 * F.col("links") / (k * (k - 1))).otherwise(0.0)).withColumn("effective_size", F.when(k > 1, F.greatest(F.lit(0.0), k - F.col("links") / k)).otherwise(k.cast("double")))


@tidied("constraint")
def constraint(edges: DataFrame) -> DataFrame:
    """id, constraint: sum over neighbours of (1/k + sum over mutual neighbours m of 1/k 1/deg m) squared, 1 with fewer than two neighbours.

    Mutual neighbours come from the triangles, each of which gives its three
    edges the third node, so no hub meets all pairs of its neighbours.
    """
    both = keep(undirected(edges), "both")
    closed, degree = _closed(both)
    third = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.col(m).alias("m")) for x, y, m in (("u", "v", "w"), ("u", "w", "v"), ("v", "w", "u"))])
    found = closed.select(F.explode(third).alias("t")).select("t.*").join(degree.select(F.col("id").alias("m"), (1.0 / F.col("degree")).alias("s")), "m").groupBy("u", "v").agg(F.sum("s").alias("s"))
    found = keep(found, "mutual")
    mutual = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    e = both.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    parts = e.join(mutual, ["u", "v"], "left").join(degree.select(F.col("id").alias("u"), F.col("degree").alias("k")), "u")
    one = (1.0 + F.coalesce("s", F.lit(0.0))) / F.col("k")
    return parts.groupBy(F.col("u").alias("id")).agg(F.sum(one * one).alias("c"), F.first("k").alias("k")).select("id", F.when(F.col("k") > 1, F.least(F.lit(1.0), F.col("c"))).otherwise(1.0).alias("constraint"))


@tidied("distances")
def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, id, distance: breadth-first search from every source over directed edges, a round at a time."""
    reach = keep(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")), "reach")
    front, step = reach, 0
    while most is None or step < most:
        step += 1
        new = front.join(edges, front["id"] == edges["src"]).select("source", F.col("dst").alias("id")).distinct().join(reach, ["source", "id"], "left_anti").withColumn("distance", F.lit(step))
        front = keep(new, "front")
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return reach


def neighbourhood(edges: DataFrame, center, depth: int = 2) -> DataFrame:
    """id, distance, is_center within `depth` steps of any direction."""
    if not 1 <= depth <= 5:
        raise ValueError("depth must be between 1 and 5")
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(center).alias("id"))
    out = distances(undirected(edges), start, depth)
    return out.select("id", "distance", (F.col("distance") == 0).alias("is_center"))


@tidied("shortest-paths")
def shortest_paths(edges: DataFrame, pairs: DataFrame, missing: int = 999, most: int | None = None) -> DataFrame:
    """a, b, shortest_path: undirected distance of each pair, `missing` if there is none.

    Pairs that are linked, or that no path joins, are told by joins. The others
    are searched from the side with fewer different nodes, only while pairs are
    open and for sources that still have one: in tasks that hold a component,
    or by rounds where it is too large.
    """
    pairs = keep(pairs, "pairs")
    sides = pairs.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
    near, far = ("a", "b") if sides["a"] <= sides["b"] else ("b", "a")
    asked = keep(pairs.select(F.col(near).alias("source"), F.col(far).alias("id")).distinct(), "asked")
    both = keep(undirected(edges), "both")
    found = asked.where("source = id").withColumn("distance", F.lit(0))
    if most is None or most > 0:
        linked = both.select(F.col("src").alias("source"), F.col("dst").alias("id"))
        found = found.unionByName(asked.join(linked, ["source", "id"], "left_semi").withColumn("distance", F.lit(1)))
        parts = keep(components(nodes_of(both), both), "components")
        e, sizes = walks.sizes(both, parts)
        inside = asked.where("source <> id").join(linked, ["source", "id"], "left_anti").join(parts.withColumnRenamed("id", "source"), "source")
        open_ = keep(inside.join(parts, ["id", "component"]).select("component", "source", "id"), "open")
        kind = dict(parts.dtypes)["id"]

        def between(edges: pa.Table, asked: pa.Table) -> pa.Table:
            walk = Walk(edges, [asked["source"], asked["id"]])
            return pa.table({"source": asked["source"], "id": asked["id"], "distance": pa.array(walk.between(*walk.codes, most))})

        met = walks.searched(e, sizes, open_, "source", between, f"source {kind}, id {kind}, distance long").where("distance >= 0")
        found = found.unionByName(met.withColumn("distance", F.col("distance").cast("int")))
        large = sizes.where(F.col("m") > walks.LOCAL_EDGES)
        if not large.isEmpty():
            found = found.unionByName(_by_rounds(e.join(large, "component", "left_semi").select("src", "dst"), open_.join(large, "component", "left_semi").select("source", "id"), most))
    out = found.select(F.col("source").alias(near), F.col("id").alias(far), "distance")
    return pairs.join(out, ["a", "b"], "left").select("a", "b", F.coalesce("distance", F.lit(missing)).alias("shortest_path"))


def _by_rounds(both: DataFrame, asked: DataFrame, most: int | None) -> DataFrame:
    """source, id, distance of the pairs asked that a path joins within `most` steps, a round of joins for each step."""
    both, open_ = keep(both, "both"), keep(asked, "open")
    seen = front = open_.select("source").distinct().select("source", F.col("source").alias("id"))
    found, step = open_.limit(0).withColumn("distance", F.lit(0)), 0
    while (most is None or step < most) and not open_.isEmpty():
        step += 1
        alive = front.join(open_.select("source").distinct(), "source", "left_semi")
        new = alive.join(both, alive["id"] == both["src"]).select("source", F.col("dst").alias("id")).distinct()
        front = keep(new.join(seen, ["source", "id"], "left_anti"), "front")
        if front.isEmpty():
            break
        met = keep(open_.join(front, ["source", "id"], "left_semi").withColumn("distance", F.lit(step)), "met")
        found = found.unionByName(met)
        open_ = keep(open_.join(met, ["source", "id"], "left_anti"), "open")
        seen = seen.unionByName(front)
    return found


@tidied("diameter")
def diameter(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """diameter and avg_path_length of the largest component, undirected; null where it has more than `most` nodes or fewer than two."""
    parts = keep(components(nodes, edges), "components")
    top = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").first()
    if top is None or not 2 <= top["n"] <= most:
        return nodes.sparkSession.createDataFrame([(None, None)], "diameter int, avg_path_length double")
    inside = parts.where(F.col("component") == top["component"]).select("id")
    d = distances(undirected(subgraph(edges, inside)), inside).where("distance > 0")
    return d.agg(F.max("distance").alias("diameter"), F.avg("distance").alias("avg_path_length"))


@tidied("path-metrics")
def path_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, closeness, harmonic, eccentricity, reached: over the distances to each node along directed edges.

    Closeness is scaled by the share of nodes that reach it; harmonic is the
    sum of inverse distances. A component that a task can hold is searched
    there, from all its nodes, and gives back sums for each node; the others
    are searched by rounds of joins.
    """
    nodes = keep(nodes, "nodes")
    n = nodes.count()
    edges = keep(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    parts = keep(components(nodes_of(edges), edges), "components")
    e, sizes = walks.sizes(edges, parts)
    kind = dict(parts.dtypes)["id"]

    def sums(edges: pa.Table, asked: pa.Table) -> pa.Table:
        walk = Walk(edges, [asked["id"]])
        found = walk.path_sums(walk.codes[0])
        return pa.table({"id": walk.names, **{k: pa.array(v) for k, v in found.items()}})

    into = walks.searched(e, sizes, nodes.select("id").join(parts, "id"), "id", sums, f"id {kind}, total long, reached long, harmonic double, eccentricity long")
    large = sizes.where(F.col("m") > walks.LOCAL_EDGES)
    if not large.isEmpty():
        d = distances(e.join(large, "component", "left_semi").select("src", "dst"), nodes.join(parts.join(large, "component", "left_semi"), "id", "left_semi")).where("distance > 0")
        into = into.unionByName(d.groupBy("id").agg(F.sum("distance").alias("total"), F.count("*").alias("reached"), F.sum(1.0 / F.col("distance")).alias("harmonic"), F.max("distance").cast("long").alias("eccentricity")))
    into = into.groupBy("id").agg(F.sum("total").alias("total"), F.sum("reached").alias("reached"), F.sum("harmonic").alias("harmonic"), F.max("eccentricity").cast("int").alias("eccentricity")).where("reached > 0")
    r = F.col("reached")
    return nodes.join(into, "id", "left").select("id", F.coalesce(r / F.col("total") * r / F.lit(max(1, n - 1)), F.lit(0.0)).alias("closeness"), F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"), F.coalesce("eccentricity", F.lit(0)).alias("eccentricity"), F.coalesce(r, F.lit(0)).alias("reached"))


@tidied("estimated-paths")
def estimated_path_metrics(edges: DataFrame, nodes: DataFrame, bits: int = 12, most: int = 100) -> DataFrame:
    """path_metrics by sketches: closeness, harmonic, eccentricity and reached of every node, without a row for every two nodes.

    A node's sketch counts the different nodes that reach it; a round unites it
    with those of the nodes linked to it, so after d rounds it counts the nodes
    within d steps, and the growth of the counts gives the sums over distances.
    Counts are off by about 1.04 / 2**(bits / 2), 1.6 % at 12 bits. A node
    whose count no longer grows by what the sketch can tell has settled, and
    rounds end when all have, or after `most`. Ids are integers.
    """
    n = nodes.count()
    e = keep(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    zero = F.lit(0.0)
    state = keep(nodes.select("id").groupBy("id").agg(F.hll_sketch_agg("id", bits).alias("sketch")).select("id", "sketch", F.lit(1.0).alias("seen"), zero.alias("total"), zero.alias("harmonic"), F.lit(0).alias("eccentricity")), "sketches")
    for d in range(1, most + 1):
        into = e.join(state.select(F.col("id").alias("src"), "sketch"), "src").select(F.col("dst").alias("id"), "sketch")
        united = into.unionByName(state.select("id", "sketch")).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch"))
        now = united.withColumn("now", F.greatest(F.hll_sketch_estimate("sketch").cast("double"), F.lit(1.0)))
        met = state.drop("sketch").join(now, "id")
        more = F.greatest(F.col("now") - F.col("seen"), zero)
        new = met.select("id", "sketch", F.greatest("now", "seen").alias("seen"), (F.col("total") + d * more).alias("total"), (F.col("harmonic") + more / d).alias("harmonic"), F.when(more > 0, d).otherwise(F.col("eccentricity")).alias("eccentricity"), (more > 0).alias("grown"))
        new = keep(new, "sketches")
        grown = not new.where("grown").isEmpty()
        state, before = new.drop("grown"), state
        discard(before)
        if not grown:
            break
    r = F.col("seen") - 1
    return state.select("id", F.when(F.col("total") > 0, r / F.col("total") * r / F.lit(max(1, n - 1))).otherwise(0.0).alias("closeness"), "harmonic", "eccentricity", F.round(r).cast("long").alias("reached"))


@tidied("betweenness")
def betweenness(edges: DataFrame, nodes: DataFrame, normalised: bool = True, sampled_above: int | None = None, seed: int = 42) -> DataFrame:
    """id, betweenness of the directed graph: shortest paths are counted forward from every node and dependencies summed backward.

    A component that a task can hold is searched in tasks, larger ones by
    rounds of joins for some sources at a time, so what is held at once does
    not grow with nodes times edges. If `sampled_above` is given, paths of
    graphs of more nodes are counted from min(100, n / 10) of them, those with
    the least hashes, and scaled up to all.
    """
    nodes = keep(nodes.select("id"), "nodes")
    n = nodes.count()
    sources, scale = nodes, 1.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0
    if sampled_above is not None and n > sampled_above:
        some = min(100, max(1, n // 10))
        sources = keep(nodes.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(some), "sources")
        scale *= n / some
    edges = keep(edges.select("src", "dst"), "edges")
    parts = keep(components(nodes_of(edges), edges), "components")
    e, sizes = walks.sizes(edges, parts)
    kind, few = dict(parts.dtypes)["id"], FEW

    def dependencies(edges: pa.Table, asked: pa.Table) -> pa.Table:
        walk = Walk(edges, [asked["id"]])
        return pa.table({"id": walk.names, "delta": pa.array(walk.dependencies(walk.codes[0], edges.num_rows > few * walk.n))})

    found = walks.searched(e, sizes, sources.join(parts, "id"), "id", dependencies, f"id {kind}, delta double")
    for rest in _dependencies_by_rounds(e, sizes, sources.join(parts, "id"), parts):
        found = found.unionByName(rest)
    return nodes.join(found.groupBy("id").agg(F.sum("delta").alias("b")), "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


#: Edges a node up to which paths may have many steps.
FEW = 8
#: Rows (source, node) that a search by rounds holds at once.
ROUND_ROWS = 1 << 28


def _dependencies_by_rounds(edges: DataFrame, sizes: DataFrame, sources: DataFrame, parts: DataFrame) -> Iterator[DataFrame]:
    """id, delta of the components that no task holds, for as many sources at a time as make ROUND_ROWS rows."""
    large = sizes.where(F.col("m") > walks.LOCAL_EDGES)
    if large.isEmpty():
        return
    edges = edges.join(large.select("component"), "component", "left_semi").select("src", "dst")
    sources = keep(sources.join(large.select("component"), "component", "left_semi").select("component", "id"), "sources")
    per = sources.groupBy("component").agg(F.count("*").alias("k")).join(parts.groupBy("component").agg(F.count("*").alias("n")), "component")
    blocks = max(1, math.ceil((per.agg(F.sum(F.col("k").cast("double") * F.col("n"))).first()[0] or 0.0) / ROUND_ROWS))
    for b in range(blocks):
        yield _summed_dependencies(edges, sources.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id"))


@tidied("deltas")
def _summed_dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    found = _dependencies(edges, sources)
    if found is None:
        return sources.limit(0).withColumn("delta", F.lit(0.0))
    return found.groupBy("id").agg(F.sum("delta").alias("delta"))


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame | None:
    """id, delta: the shares of shortest paths through a node from each source and step, a round of joins for each step; None without paths."""
    reach = keep(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "paths")
    front, levels = reach, [reach]
    with held(edges, "src") as out:
        while True:
            step = len(levels)
            new = front.join(out, front["id"] == out["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")).join(reach, ["source", "id"], "left_anti")
            front = keep(new.select("source", "id", F.lit(step).alias("d"), "paths"), "paths")
            if front.isEmpty():
                break
            levels.append(front)
            reach = reach.unionByName(front)
    below = None
    totals = []
    with held(edges, "dst") as into:
        for level in reversed(levels[1:]):
            own = level if below is None else level.join(below, ["source", "id"], "left")
            dep = keep(own.select("source", "id", "paths", (F.coalesce("delta", F.lit(0.0)) if below is not None else F.lit(0.0)).alias("delta")), "deltas")
            totals.append(dep.select("id", "delta"))
            up = levels[levels.index(level) - 1]
            w = dep.select("source", F.col("id").alias("dst"), ((1.0 + F.col("delta")) / F.col("paths")).alias("share"))
            below = into.join(w, "dst").join(up.select("source", F.col("id").alias("src"), F.col("paths").alias("p")), ["source", "src"]).groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("delta"))
    if not totals:
        return None
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    return every


@tidied("components")
def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id that is reachable in any direction."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(found.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def moved_labels(both: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """One round of local moving for modularity: nodes whose turn it is go to the community around them that gains most.

    both has weights w, labels has id, k (weighted degree) and community. A move
    gains what a node's links to the community weigh, less k times the
    community's degree over the total; the node's own part of its community is
    left out. Gains are compared times the total, in whole numbers if the
    weights are. Half the nodes, by a hash of id and turn, may move in one
    round, so that neighbours do not swap for ever; still: the node would stay
    if it might move.
    """
    sizes = labels.groupBy("community").agg(F.sum("k").alias("degree"))
    near = both.join(labels.select(F.col("id").alias("dst"), "community").hint("merge"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("inside"))
    own = labels.select("id", "community").withColumn("inside", F.lit(0).cast(dict(both.dtypes)["w"]))
    offers = near.unionByName(own).groupBy("id", "community").agg(F.sum("inside").alias("inside")).join(sizes.hint("merge"), "community")
    offers = offers.join(labels.select("id", "k", F.col("community").alias("old")).hint("merge"), "id")
    rest = F.col("degree") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0)
    gain = F.col("inside") * F.lit(total) - F.col("k") * rest
    best = offers.groupBy("id").agg(F.max_by("community", F.struct(gain.alias("g"), (F.col("community") == F.col("old")).alias("stay"), -F.col("community"))).alias("new"), F.first("k").alias("k"), F.first("old").alias("old"))
    mine = F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(turn)), F.lit(2)) == 0
    return best.select("id", "k", F.when(mine, F.col("new")).otherwise(F.col("old")).alias("community"), (F.col("new") == F.col("old")).alias("still"))


def connected_parts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """id, community of labels (id, community): each community parted into its connected parts, named by their least ids."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("_a")), labels.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    inside = links.select("src", "dst").join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(F.col("_a") == F.col("_b")).select("src", "dst")
    return components(labels.select("id"), inside).select("id", F.col("component").alias("community"))


def moved_until_still(links: DataFrame, labels: DataFrame, total: float, rounds: int) -> DataFrame:
    """Labels after rounds of local moving, until no node would move."""
    labels = keep(labels, "labels")
    for turn in range(rounds):
        new, before = keep(moved_labels(links, labels, total, turn), "labels"), labels
        labels = new.select("id", "k", "community")
        discard(before)
        if new.where(~F.col("still")).isEmpty():
            break
    return labels


@tidied("communities")
def modularity_communities(nodes: DataFrame, edges: DataFrame, levels: int = 10, rounds: int = 16, refined: bool = True) -> DataFrame:
    """id, community (the least id in it) by modularity: local moving, refinement, then refined parts become nodes, until a level changes nothing.

    Refinement moves the nodes of each community anew from one node each,
    along links inside the community only, and parts what is not connected; the
    next level starts with the refined parts in the communities they come from,
    so that a part can leave the community that a whole community could not. A
    community of the result is connected: those that are not are parted at the
    end, which never lowers modularity. Without refinement whole communities
    become nodes. Ids are integers. Nodes without edges are communities of
    their own.

    Components do not know of each other but for the weight of the whole graph.
    One that a task can hold is worked on there (moves.communities, the same
    steps on arrays, with the same result); larger ones by rounds of joins, one
    after the other.
    """
    both = keep(undirected(edges), "both")
    total = both.count()
    if not total:
        return nodes.select("id", F.col("id").alias("community"))
    parts = keep(components(nodes_of(both), both), "components")
    e, sizes = walks.sizes(both, parts)
    kind = dict(parts.dtypes)["id"]

    def local(edges: pa.Table, asked: pa.Table) -> pa.Table:
        src, dst = (edges[c].to_numpy().astype(np.int64) for c in ("src", "dst"))
        ids = np.unique(src)
        found = moves.communities(ids, np.searchsorted(ids, src), np.searchsorted(ids, dst), total, levels, rounds, refined)
        return pa.table({"id": ids, "community": ids[found]}).cast(pa.schema([("id", edges["src"].type), ("community", edges["src"].type)]))

    found = walks.searched(e, sizes, sizes.select("component", F.col("component").alias("id")), "id", local, f"id {kind}, community {kind}")
    for r in sizes.where(F.col("m") > walks.LOCAL_EDGES).select("component").collect():  # few, each as large as a task can't hold
        own = e.where(F.col("component") == r["component"]).select("src", "dst")
        found = found.unionByName(_communities_by_rounds(nodes_of(own), own, total, levels, rounds, refined))
    return nodes.select("id").join(found.hint("merge"), "id", "left").select("id", F.coalesce("community", "id").alias("community"))


@tidied("communities")
def _communities_by_rounds(nodes: DataFrame, both: DataFrame, total: int, levels: int, rounds: int, refined: bool) -> DataFrame:
    """id, community of one component, from both directions of its edges."""
    weighted = whole = keep(both.withColumn("w", F.lit(1).cast("long")), "weights")
    member = nodes.select("id", F.col("id").alias("node"))  # the node that an id is part of now
    start: DataFrame | None = None  # the communities nodes begin in
    for _ in range(levels):
        degree = keep(weighted.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degree")
        n = degree.count()
        first = degree.select("id", "k", F.col("id").alias("community")) if start is None else degree.join(start.hint("merge"), "id").select("id", "k", "community")
        links = weighted.where("src <> dst")
        labels = moved_until_still(links, first, total, rounds)
        parts = labels.select("id", "community")
        if refined:
            a, b = parts.select(F.col("id").alias("src"), F.col("community").alias("_a")), parts.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
            inside = keep(links.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(F.col("_a") == F.col("_b")).select("src", "dst", "w"), "inside")
            fine = moved_until_still(inside, degree.select("id", "k", F.col("id").alias("community")), total, rounds)
            parts = connected_parts(inside, fine.select("id", "community"))
            if parts.select("community").distinct().count() == n:  # nothing to merge: the communities' connected parts do
                parts = connected_parts(inside, labels.select("id", "community"))
        # A part is named by its least node, and begins in the community of its nodes, named by its least part.
        named = parts.join(parts.groupBy("community").agg(F.min("id").alias("to")).hint("merge"), "community").select("id", "to")
        named = keep(named.join(labels.select("id", "community").hint("merge"), "id"), "parts")
        start = keep(named.join(named.groupBy("community").agg(F.min("to").alias("least")).hint("merge"), "community").select(F.col("to").alias("id"), F.col("least").alias("community")).distinct(), "start")
        member = keep(member.join(named.select(F.col("id").alias("node"), "to").hint("merge"), "node", "left").select("id", F.coalesce("to", "node").alias("node")), "members")
        if start.count() == n:  # every part is one node
            break
        a, b = named.select(F.col("id").alias("src"), F.col("to").alias("s")), named.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        weighted = keep(weighted.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "weights")
    labels = keep(member.join(start.withColumnRenamed("id", "node").hint("merge"), "node", "left").select("id", F.coalesce("community", "node").alias("community")), "labels")
    if refined:
        return connected_parts(whole, labels)
    return labels.join(labels.groupBy("community").agg(F.min("id").alias("to")).hint("merge"), "community").select("id", F.col("to").alias("community"))


@tidied("communities")
def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community: synchronous label propagation, each node taking the commonest label around it and itself, ties to the least."""
    both = keep(undirected(edges), "both")
    labels = keep(nodes.select("id", F.col("id").alias("community")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.hint("merge"), both["dst"] == labels["id"]).select(F.col("src").alias("id"), "community").unionByName(labels)
        counted = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        best = counted.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        new = keep(best, "labels")
        same = new.join(labels.hint("merge"), ["id", "community"], "left_anti").isEmpty()
        labels = new
        if same:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, size, internal (edges), degree and its part of the modularity: internal / m - (degree / 2m) squared."""
    both = undirected(edges)
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    ends = both.join(a, "src").join(b, "dst")
    per = ends.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("degree"), F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("inside"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    m = F.broadcast(both.agg((F.count("*") / 2.0).alias("m")))  # one row
    out = sizes.join(per, "community", "left").na.fill(0, ["degree", "inside"]).join(m)
    part = F.when(F.col("m") > 0, F.col("inside") / 2.0 / F.col("m") - F.pow(F.col("degree") / (2.0 * F.col("m")), F.lit(2.0))).otherwise(0.0)
    return out.select("community", "size", (F.col("inside") / 2).cast("long").alias("internal"), "degree", part.alias("modularity"))


def bridges(edges: DataFrame, labels: DataFrame, between: DataFrame) -> DataFrame:
    """id, inter, communities, ratio, bridge_score, is_bridge: nodes that join communities."""
    both = undirected(edges)
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    far = F.when(F.col("ca") != F.col("cb"), F.col("cb"))
    per = both.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("total"), F.count(far).alias("inter"), F.count_distinct(far).alias("communities"))
    out = per.join(between, "id").join(clustering(edges).select("id", "effective_size"), "id").withColumn("ratio", F.col("inter") / F.col("total"))
    score = 0.3 * F.col("ratio") + 0.2 * F.least(F.lit(1.0), F.col("communities") / 3.0) + 0.3 * F.col("betweenness") + 0.2 * F.least(F.lit(1.0), F.col("effective_size") / 5.0)
    out = out.withColumn("bridge_score", score)
    return out.select("id", "inter", "communities", "ratio", "bridge_score", ((F.col("bridge_score") > 0.25) & (F.col("communities") >= 1) & (F.col("ratio") >= 0.1)).alias("is_bridge"))


def common_neighbours(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """a, b, common, adamic_adar for pairs a < b with a common neighbour, or for the given pairs (0 without one).

    Of a given pair the neighbours of the end that has fewer are looked up, so a
    hub costs what its partners have. Without pairs there is a row for every
    two neighbours of a node, as the result has, which is for graphs without hubs.
    """
    both = undirected(edges)
    degree = both.groupBy(F.col("src").alias("z")).agg(F.count("*").alias("k"))
    near = both.select(F.col("src").alias("z"), F.col("dst").alias("n"))
    weight = degree.select("z", F.when(F.col("k") > 1, 1.0 / F.log(F.col("k").cast("double"))).otherwise(0.0).alias("w"))
    if pairs is None:
        met = near.join(weight, "z").withColumnRenamed("n", "a").join(near.select("z", F.col("n").alias("b")), "z").where("a < b")
        return met.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum("w").alias("adamic_adar"))
    asked = pairs.select("a", "b")
    for side in ("a", "b"):
        asked = asked.join(degree.select(F.col("z").alias(side), F.col("k").alias(f"k{side}")), side)
    small = F.col("ka") <= F.col("kb")
    from_ = asked.distinct().select("a", "b", F.when(small, F.col("a")).otherwise(F.col("b")).alias("n"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("other"))
    met = from_.join(near, "n").join(near.withColumnRenamed("n", "other"), ["other", "z"], "left_semi").join(weight, "z")
    found = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum("w").alias("adamic_adar"))
    return pairs.select("a", "b").join(found, ["a", "b"], "left").na.fill({"common": 0, "adamic_adar": 0.0})


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def activity(events: DataFrame, as_of: float) -> DataFrame:
    """id, activity of rows (id, ts in seconds): half recency by exp(-age / 365 days), 0.3 frequency up to ten, 0.2 spread over all time."""
    span = F.broadcast(events.agg((F.max("ts") - F.min("ts")).alias("whole")))  # one row
    per = events.groupBy("id").agg(F.max("ts").alias("last"), F.min("ts").alias("first"), F.count("*").alias("n")).join(span).where("whole > 0")
    score = 0.5 * F.exp(-(F.lit(float(as_of)) - F.col("last")) / (365.0 * 86400)) + 0.3 * F.least(F.lit(1.0), F.col("n") / 10.0) + 0.2 * F.when(F.col("n") > 1, F.least(F.lit(1.0), (F.col("last") - F.col("first")) / F.col("whole"))).otherwise(0.0)
    return per.select("id", "n", score.alias("activity"))


def top(df: DataFrame, metric: str, k: int = 10, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col(metric).desc(), id_col).limit(k)


def monthly_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """month, nodes, internal, external edges and density, by the month of each node's `created`."""
    of = nodes.select("id", F.date_format("created", "yyyy-MM").alias("month"))
    a, b = of.select(F.col("id").alias("src"), F.col("month").alias("ma")), of.select(F.col("id").alias("dst"), F.col("month").alias("mb"))
    ends = edges.join(a, "src").join(b, "dst").withColumn("same", F.col("ma") == F.col("mb"))
    per = ends.select(F.explode(F.array_distinct(F.array("ma", "mb"))).alias("month"), "same").groupBy("month").agg(F.sum(F.col("same").cast("long")).alias("internal"), F.sum((~F.col("same")).cast("long")).alias("external"))
    n = of.groupBy("month").agg(F.count("*").alias("nodes"))
    return n.join(per, "month", "left").na.fill(0, ["internal", "external"]).withColumn("density", F.when(F.col("nodes") > 1, F.col("internal") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def temporal_insights(activities: DataFrame, months: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """Mean activity, the most active nodes, and periods: their number, mean density and range of nodes and density."""
    return {
        "activity": activities.agg(F.count("*").alias("nodes"), F.avg("activity").alias("avg_activity")),
        "top": top(activities, "activity", limit),
        "periods": months.agg(F.count("*").alias("periods"), F.min("month").alias("first"), F.max("month").alias("last"), F.avg("density").alias("avg_density"), F.min("density").alias("min_density"), F.max("density").alias("max_density"), F.min("nodes").alias("min_nodes"), F.max("nodes").alias("max_nodes")),
    }


def temporal_events(nodes: DataFrame) -> DataFrame:
    """id, kind, ts (seconds): creation and modification of each node, from its own attribute or else its file's time."""
    made = F.coalesce("creation_time", "file_created")
    changed = F.coalesce("modified_time", "file_modified")
    rows = F.array(F.struct(F.lit("created").alias("kind"), made.alias("ts")), F.struct(F.lit("modified").alias("kind"), changed.alias("ts")))
    return nodes.select("id", F.explode(rows).alias("e")).select("id", "e.kind", "e.ts").where("ts is not null")


def modularity_contribution(labels: DataFrame) -> DataFrame:
    """id, contribution: one over the size of its community."""
    return labels.join(labels.groupBy("community").agg(F.count("*").alias("n")), "community").select("id", (1.0 / F.col("n")).alias("contribution"))


def top_bridges(found: DataFrame, limit: int = 10) -> DataFrame:
    """The bridge nodes with the highest scores."""
    return top(found.where("is_bridge"), "bridge_score", limit)


def relationship_counts(edges: DataFrame) -> DataFrame:
    """rel_type, n: how many edges there are of each type, commonest first."""
    return edges.groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rel_type")


def reachable(edges: DataFrame, start, most: int = 3) -> DataFrame:
    """id, distance of the nodes within `most` directed steps of a node, itself left out."""
    first = edges.sparkSession.range(1).select(F.lit(start).alias("id"))
    return distances(edges.select("src", "dst").distinct(), first, most).where("distance > 0").select("id", "distance")


def tag_context(tagged: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """id, linked: notes (id, tag) with a tag and the sorted targets of their links, none for notes without."""
    notes = tagged.where(F.col("tag") == tag).select("id").distinct()
    out = notes.join(links.select(F.col("src").alias("id"), "dst").distinct(), "id", "left")
    return out.groupBy("id").agg(F.array_sort(F.collect_list("dst")).alias("linked"))


def succession(rows: DataFrame, order: list[str], node: str) -> DataFrame:
    """src, dst: each row's node and that of the next row in the order of the whole table, where they differ, once.

    Rows are dealt to ranges of the order; a range finds its own successions,
    and the first and last row of each range, as many rows as there are
    partitions, give those between ranges.
    """
    dealt = keep(rows.select(*order, F.col(node).alias("src")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("dst", F.lead("src").over(Window.partitionBy("_range").orderBy(*order))).select("src", "dst")
    key = F.struct(*order)
    edge = dealt.groupBy("_range").agg(F.min_by("src", key).alias("head"), F.max_by("src", key).alias("tail"), F.min(key).alias("at"))
    between = edge.select(F.col("tail").alias("src"), F.lead("head").over(Window.orderBy("at")).alias("dst"))
    return inside.unionByName(between).where("src <> dst").distinct()


def first_per(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each key in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
