"""Approximate nearest neighbours: a vantage-point tree in each shard.

Vectors are scaled to length one, where nearness by cosine and by distance are
the same. Shards hold vectors near one of PIVOTS sampled ones, and each gets a
tree: a node has several vantage points, its rows are halved at the median of
their distances to the first, and every row keeps its distances to all vantage
points above it. The triangle inequality bounds the distance of a query to a
shard, a node or a row from below by the greatest difference of distances to
the same vantage point. What is bounded is skipped when its bound times
`factor` exceeds the distance of the k-th best so far; factor one therefore
skips only what cannot win and is exact, and is what `nearest` works with. A
greater factor can be given, or tuned on a bounded sample; what it finds on
that sample says little about tables with other groups or of other sizes.
Queries first search the shard of their own pivot, then those that the distance
of its k-th best leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.vectors import clean_vectors, pack_groups, ranked_rows, stacked, unpack
from marginalia.session import discard, keep, table

#: Vectors in a shard, in a leaf; queries in a block; vantage points of a node; pivots that shards are dealt by.
SHARD, LEAF, QUERIES, VANTAGES, PIVOTS = 8192, 128, 512, 8, 64
#: Factors that are tried on a sample of at most SAMPLE vectors, the most daring first, and the recall there that one must reach.
FACTORS, SAMPLE, RECALL = (4.0, 3.5, 3.0, 2.5, 2.0, 1.6, 1.3, 1.15, 1.0), 4096, 0.95
#: Rounding that bounds allow for, and within which distances are settled by scores.
SLACK = 1e-6


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def cosines(q: np.ndarray, norm: float, v: np.ndarray, norms_: np.ndarray) -> np.ndarray:
    """Of one vector with each row, summed in one order wherever a row stands, so that equal rows have equal scores."""
    return np.einsum("ij,ij->i", np.broadcast_to(q, v.shape), v) / (norm * norms_)


@dataclass
class Tree:
    """order: rows by leaf; path[i]: distances of order[i] to the vantage points above it; a node is (begin, end, depth, left, right), leaves have left -1."""

    order: np.ndarray
    path: np.ndarray
    nodes: np.ndarray
    vantages: np.ndarray  # rows, VANTAGES for each node
    low: np.ndarray  # least and greatest of path over each node's rows
    high: np.ndarray

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.order.astype(np.int64), self.path.astype(np.float32), self.nodes.astype(np.int64), self.vantages.astype(np.int64), self.low.astype(np.float32), self.high.astype(np.float32))]

    @staticmethod
    def unpack(raw: list[bytes]) -> Tree:
        kinds = (np.int64, np.float32, np.int64, np.int64, np.float32, np.float32)
        order, path, nodes, vantages, low, high = (np.frombuffer(x, k) for x, k in zip(raw, kinds, strict=True))
        nodes = nodes.reshape(-1, 5)
        n = len(nodes)
        return Tree(order, path.reshape(len(order), -1), nodes, vantages.reshape(n, -1), low.reshape(n, -1), high.reshape(n, -1))


def build(u: np.ndarray, leaf: int = 0, seed: int = 1) -> Tree:
    leaf = leaf or LEAF
    r = np.random.default_rng(seed)
    order, nodes, vantages = np.arange(len(u)), [], []
    depth = max(0, int(np.ceil(np.log2(max(1, len(u) / leaf)))))
    path = np.zeros((len(u), depth * VANTAGES), np.float32)

    def split(begin: int, end: int, level: int) -> int:
        me, m = len(nodes), VANTAGES
        nodes.append([begin, end, level, -1, -1])
        vantages.append(np.zeros(m, np.int64))
        if level == depth or end - begin <= leaf:
            return me
        rows = order[begin:end]
        # The row farthest from a random one spreads distances most; the others are random.
        first = rows[np.argmin(u[rows] @ u[rows[r.integers(len(rows))]])]
        vantages[me] = np.concatenate([[first], r.choice(rows, m - 1, replace=len(rows) < m)])
        d = distances(u[rows], u[vantages[me]])
        by = np.argsort(d[:, 0], kind="stable")
        order[begin:end], path[begin:end] = rows[by], path[begin:end][by]
        path[begin:end, level * m : level * m + m] = d[by]
        half = begin + (end - begin) // 2
        nodes[me][3:] = [split(begin, half, level + 1), split(half, end, level + 1)]
        return me

    split(0, len(u), 0)
    low, high = (np.stack([f(path[a:b], axis=0) for a, b, *_ in nodes]) for f in (np.min, np.max))
    return Tree(order, path, np.asarray(nodes), np.stack(vantages), low, high)


def search(u: np.ndarray, ids: np.ndarray, tree: Tree, q: np.ndarray, own: np.ndarray, k: int, factor: float, reach: np.ndarray | None = None, originals: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """(row numbers of each query's k nearest found, -1 where there are fewer, distances computed).

    Rows whose distances differ by rounding are ranked by their cosines with
    the query, of the original vectors (queries, rows) if those are given; ties
    go to smaller ids. reach: distance that a row must not exceed to be of use,
    the k-th best known so far.
    """
    n, m = len(q), VANTAGES
    a, c = (q, u) if originals is None else originals
    na, nc = norms(a), norms(c)
    near, rows, scores = np.full((n, k), np.inf), np.full((n, k), -1), np.full((n, k), -np.inf)
    reach = np.full(n, np.inf) if reach is None else reach
    seen, above, computed = np.full(n, -1), np.zeros((n, tree.path.shape[1])), 0

    def limit(who: np.ndarray) -> np.ndarray:
        return np.minimum(near[who, k - 1], reach[who]) + SLACK

    def scan(node: int, who: np.ndarray) -> None:
        nonlocal computed
        begin, end, level = tree.nodes[node, :3].tolist()
        part, path, top = tree.order[begin:end], tree.path[begin:end], limit(who)
        bound, most = np.zeros((len(who), len(part))), np.full((len(who), len(part)), np.inf)
        for x in range(level * m):
            np.maximum(bound, np.abs(above[who, x, None] - path[None, :, x]), out=bound)
            np.minimum(most, above[who, x, None] + path[None, :, x], out=most)
        alive = (np.minimum((bound - SLACK) * factor, most - SLACK) <= top[:, None]) & (own[who][:, None] != ids[part][None, :])
        for w, on in zip(who.tolist(), alive, strict=True):
            some = part[on]
            if not len(some):
                continue
            computed += len(some)
            d = distances(u[some], q[w : w + 1])[:, 0]
            edge = near[w, k - 1] if len(some) < k else min(near[w, k - 1], np.partition(d, k - 1)[k - 1])
            use = d <= edge + SLACK  # rounding of near distances is settled by the scores
            some, d = some[use], d[use]
            if not len(some):
                continue
            d = np.concatenate([near[w], d])
            at = np.concatenate([rows[w], some])
            worth = np.concatenate([scores[w], cosines(a[w], na[w], c[some], nc[some])])
            by = np.lexsort((np.where(at >= 0, ids[at], np.iinfo(np.int64).max), -worth))[:k]
            scores[w], rows[w] = worth[by], at[by]
            near[w] = np.maximum.accumulate(d[by])

    def meet(node: int, who: np.ndarray) -> None:
        nonlocal computed
        level = int(tree.nodes[node, 2])
        above[who, level * m : level * m + m] = distances(q[who], u[tree.vantages[node]])
        computed += len(who) * m

    def down(node: int, who: np.ndarray) -> None:
        """First the nearest leaf, for a limit to begin with."""
        if not len(who):
            return
        _, _, level, left, right = tree.nodes[node].tolist()
        if left < 0:
            scan(node, who)
            seen[who] = node
            return
        meet(node, who)
        c = level * m
        to_left = above[who, c] < (tree.high[left, c] + tree.low[right, c]) / 2
        down(left, who[to_left])
        down(right, who[~to_left])

    def through(node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        _, _, level, left, right = tree.nodes[node].tolist()
        if left < 0:
            who = who[seen[who] != node]
            if len(who):
                scan(node, who)
            return
        meet(node, who)
        c = level * m + m
        for child in (left, right):
            bound = np.maximum(tree.low[child, :c] - above[who, :c], above[who, :c] - tree.high[child, :c]).max(axis=1)
            most = (above[who, :c] + tree.low[child, :c]).min(axis=1)
            through(child, who[np.minimum((bound - SLACK) * factor, most - SLACK) <= limit(who)])

    down(0, np.arange(n))
    through(0, np.arange(n))
    return rows, computed


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def tuned(u: np.ndarray, ids: np.ndarray, k: int, queries: int = 200) -> float:
    """The first of FACTORS that finds RECALL of the true k nearest of sampled vectors among themselves; one is exact."""
    q = np.arange(0, len(u), max(1, len(u) // queries))
    d = distances(u[q], u)
    d[np.arange(len(q)), q] = np.inf
    k = min(k, len(u) - 1)
    if k < 1:
        return 1.0
    edge = np.partition(d, k - 1, axis=1)[:, k - 1] + SLACK
    tree = build(u)
    for factor in FACTORS:
        rows, _ = search(u, ids, tree, u[q], ids[q], k, factor)
        found = (rows >= 0) & (np.take_along_axis(d, np.maximum(rows, 0), 1) <= edge[:, None])
        if found.mean() >= RECALL:
            return factor
    return 1.0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float | None = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine, in double precision on the original vectors.

    Every valid vector is indexed; vectors that are null, empty or zero or hold
    null or non-finite components take no part, and vectors of other dimensions
    than the query's are no candidates. Ties go to smaller ids. A row with the
    query's own id is no candidate; other repeated rows are candidates of their
    own. An empty table gives an empty result; further columns, whatever their
    names, are not read. Shards are dealt by one row for each SHARD vectors, at
    most PIVOTS, those with the least id hashes, and parted by id hash where
    more than SHARD vectors are near one of them. Factor one finds the true
    nearest; None tunes the factor on the SAMPLE vectors with the least id
    hashes, which promises nothing for the rest.
    """

    def prepared(df: DataFrame) -> DataFrame:
        return clean_vectors(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))

    spark, candidates = vectors.sparkSession, prepared(vectors)
    wanted = min(PIVOTS, -(-candidates.count() // SHARD))
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "dim", "v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots: dict[int, np.ndarray] = {}
    for row in sample[:wanted]:
        pivots[row["dim"]] = np.concatenate([pivots.get(row["dim"], np.zeros((0, row["dim"]))), unit(np.asarray([row["v"]]))])
    if factor is None:
        dims = [row["dim"] for row in sample]
        same = [row for row in sample if row["dim"] == max(set(dims), key=lambda x: (dims.count(x), x))]
        factor = tuned(unit(np.asarray([row["v"] for row in same])), np.asarray([row["id"] for row in same]), k)

    def to_pivots(dim: int, v: np.ndarray) -> np.ndarray:
        """Distances to the pivots of that dimension; without any, all are at 0 from one."""
        return distances(unit(v), pivots[dim]) if dim in pivots else np.zeros((len(v), 1))

    def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(dimension, places in the batch, vectors) of a batch (id, dim, v, ...)."""
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            yield dim, at, stacked(batch.column(2).take(pa.array(at)), dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, r = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim, at, v in by_dim(batch):
                d = to_pivots(dim, v)
                pivot[at] = d.argmin(axis=1)
                r[at] = d[np.arange(len(at)), pivot[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(r)], ["id", "dim", "v", "pivot", "r"])

    placed = keep(candidates.select("id", F.col("dim").cast("long").alias("dim"), "v").mapInArrow(place, "id long, dim long, v array<double>, pivot long, r double"), "placed")
    # One row for each pivot, and for each dimension without one.
    balls = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
    shards, ball = 0, {}
    for b in sorted(balls, key=lambda b: (b["dim"], b["pivot"])):
        ball[b["dim"], b["pivot"]] = (shards, -(-b["n"] // SHARD), b["low"], b["high"])
        shards += -(-b["n"] // SHARD)
    first = spark.createDataFrame([(d, p, s, n) for (d, p), (s, n, _, _) in ball.items()], "dim long, pivot long, shard0 long, parts long")
    dealt = placed.join(F.broadcast(first), ["dim", "pivot"]).withColumn("shard", F.col("shard0") + F.pmod(F.xxhash64("id"), F.col("parts"))).select("shard", "dim", "id", "v")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [build(unit(unpack(i, v)[1])).pack() for i, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees, pa.list_(pa.binary()))], ["shard", "dim", "ids", "v", "tree"])

    blocks = pack_groups(dealt.repartition(shards, "shard"), ["shard"], 2 * SHARD).select("shard", "dim", "ids", "v")
    index = keep(blocks.mapInArrow(grow, "shard long, dim long, ids binary, v binary, tree array<binary>"), "vp-trees", rows_per_file=8)
    discard(placed)

    def route(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """Queries (id, dim, v, reach) with the shards to search: that of the nearest pivot, or all others whose bound leaves them."""
        for batch in batches:
            for dim, at, v in by_dim(batch):
                d, reach = to_pivots(dim, v), batch.column(3).to_numpy()[at]
                own = np.asarray([ball[dim, p][0] if (dim, p) in ball else -1 for p in range(d.shape[1])])
                where = np.where(own[None, :] >= 0, d, np.inf).argmin(axis=1)
                if not (own >= 0).any():
                    continue
                rows: list[tuple[int, int]] = []
                for k_ in range(len(at)):
                    if home:
                        rows.append((k_, int(own[where[k_]])))
                        continue
                    for p in np.flatnonzero(own >= 0).tolist():
                        begin, parts, low, high = ball[dim, p]
                        if min((max(low - d[k_, p], d[k_, p] - high, 0.0) - SLACK) * factor, d[k_, p] + low - SLACK) <= reach[k_] + SLACK:
                            rows += [(k_, s) for s in range(begin, begin + parts) if s != own[where[k_]]]
                for x in range(0, len(rows), 2000):
                    some = np.asarray(rows[x : x + 2000], np.int64)
                    both = np.concatenate([v[some[:, 0]], reach[some[:, 0], None]], axis=1)
                    lists = pa.ListArray.from_arrays(pa.array((dim + 1) * np.arange(len(some) + 1), pa.int32()), pa.array(both.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[some[:, 0]])), pa.array(np.full(len(some), dim + 1)), lists, pa.array(some[:, 1])], ["id", "dim", "v", "shard"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_v, c_ids, c_v, raw in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                qi, both = unpack(q_ids, q_v)
                qv, reach = np.ascontiguousarray(both[:, :-1]), both[:, -1]
                ids, v = unpack(c_ids, c_v)
                rows, _ = search(unit(v), ids, Tree.unpack(raw), unit(qv), qi, k, factor, reach, (qv, v))
                who, at = np.nonzero(rows >= 0)
                a, c = qv[who], v[rows[who, at]]
                score = np.einsum("ij,ij->i", a, c) / (norms(a) * norms(c))
                yield pa.RecordBatch.from_arrays([pa.array(qi[who]), pa.array(ids[rows[who, at]]), pa.array(score)], ["query_id", "vec_id", "score"])

    def searched(asked: DataFrame, home: bool) -> DataFrame:
        routed = asked.mapInArrow(lambda batches: route(batches, home), "id long, dim long, v array<double>, shard long")
        packed = pack_groups(routed.repartition("shard"), ["shard"], QUERIES).select("shard", (F.col("dim") - 1).alias("dim"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
        joined = packed.join(index.hint("merge"), ["shard", "dim"]).select("q_ids", "q_v", "ids", "v", "tree")
        return keep(joined.mapInArrow(probe, "query_id long, vec_id long, score double"), "found")

    asked = prepared(queries).select("id", F.col("dim").cast("long").alias("dim"), "v")
    near = searched(asked.withColumn("reach", F.lit(float("inf"))), True)
    # A query that is there twice finds everything twice.
    kth = near.distinct().groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).alias("reach"))
    far = searched(asked.join(kth.hint("merge"), asked["id"] == kth["query_id"], "left").select("id", "dim", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach")), False)
    discard(index)
    return ranked_rows(near.unionByName(far).distinct(), k)


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
