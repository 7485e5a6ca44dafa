"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c or more are at a squared distance of 2 - 2c or less.
Rotated and split into blocks of few dimensions, a pair within that distance
must be within a block's share of it, in proportion to its dimensions, in one
block at least. So each block is range-joined alone: a tree of cuts deals its
low-dimensional points over cells, a point also visits the cells before its own
that its range reaches, and cells are compared in tiles of bounded size. The
union of candidates is verified exactly: rows with a candidate of a tile meet
once more with their whole vectors, and a pair counts in the first block whose
budget it keeps.

No row is made for a pair: a tile gives back its rows that have candidates, and
then how many links each of them has and one link to a root of the tile's
links. Equal vectors are one class and searched once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import released
from marginalia.llm.groups import BOTH, LEFT, RIGHT, Roots, in_blocks, runs
from marginalia.llm.vectors import clean_vectors, stacked
from marginalia.operators.components import connected_components
from marginalia.session import discard, keep, table, unused

#: Dimensions of a block, points a cell is meant to have, cells of a block at most, points of one side of a tile, vectors the cuts are taken from.
WIDTH, CELL, CELLS, TILE, SAMPLE = 8, 8192, 4096, 4096, 16384
#: Numbers that the boxes of all blocks of a space may take together, as every task has them; larger cells fall into more tiles.
BOX_NUMBERS = 1 << 20
#: Ids of a class in one row while classes are named.
SALTED = 100_000
#: Relative and absolute slack of budgets, beyond the rounding of coordinates to 32 bits and of sketches.
SLACK, ROUNDING = 1e-4, 1e-6
#: Steps of a sketch: a coordinate of a unit vector as one byte.
STEPS = 127


@cache
def rotation(dim: int) -> np.ndarray:
    """A rotation of a space, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, width: int) -> list[tuple[int, int]]:
    """(begin, end) of the blocks of a space's dimensions."""
    edges = np.linspace(0, dim, max(1, round(dim / width)) + 1).round().astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


class Cells:
    """Boxes of a block's space, made by cutting a sample at medians of its widest dimensions."""

    def __init__(self, sample: np.ndarray, cells: int):
        dims = sample.shape[1]
        boxes = [(sample, np.full(dims, -np.inf), np.full(dims, np.inf))]
        self.cuts: list[list[tuple[int, float]]] = []
        while len(boxes) < cells and all(len(s) > 1 for s, _, _ in boxes):
            level, halves = [], []
            for s, low, high in boxes:
                d = int(np.argmax(s.var(axis=0)))
                cut = float(np.median(s[:, d]))
                level.append((d, cut))
                left, right = high.copy(), low.copy()
                left[d], right[d] = cut, cut
                halves += [(s[s[:, d] < cut], low, left), (s[s[:, d] >= cut], right, high)]
            self.cuts.append(level)
            boxes = halves
        self.low, self.high = (np.stack([b[k] for b in boxes]) for k in (1, 2))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The box each point is in."""
        at = np.zeros(len(points), np.int64)
        for level in self.cuts:
            d, cut = np.asarray([x[0] for x in level]), np.asarray([x[1] for x in level])
            at = 2 * at + (points[np.arange(len(points)), d[at]] >= cut[at])
        return at

    def visits(self, points: np.ndarray, home: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, box) of the boxes before a point's own within the squared distance of it."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = max(1, (1 << 21) // self.low.size)
        for a in range(0, len(points), rows):
            p = points[a : a + rows, None, :]
            gap = np.maximum(np.maximum(self.low[None] - p, p - self.high[None]), 0)
            x, y = np.nonzero(((gap * gap).sum(axis=2) <= budget) & (np.arange(len(self.low))[None, :] < home[a : a + rows, None]))
            found.append((x + a, y))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (home[:0], home[:0])


def near(left: np.ndarray, right: np.ndarray, budget: float, code_l: np.ndarray, code_r: np.ndarray, whole: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points within the budget whose sketches do not rule them out; upper: only pairs of a row and a later one."""
    xs, ys = [], []
    square = (right * right).sum(axis=1)
    # A sketch is off by half a step a coordinate at most, so a distance of sketches by that twice.
    sketched = (np.sqrt(whole) * STEPS + np.sqrt(code_l.shape[1])) ** 2
    for a in range(0, len(left), 512):
        p = left[a : a + 512]
        d = (p * p).sum(axis=1)[:, None] + square[None, :] - 2 * (p @ right.T)
        x, y = np.nonzero(d <= budget)
        if upper:
            on = x + a < y
            x, y = x[on], y[on]
        for b in range(0, len(x), 1 << 15):
            u, v = x[b : b + (1 << 15)] + a, y[b : b + (1 << 15)]
            off = code_l[u].astype(np.int16) - code_r[v]
            on = np.einsum("ij,ij->i", off, off, dtype=np.int64) <= sketched
            xs.append(u[on])
            ys.append(v[on])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_vectors(vectors: DataFrame, least: float = 0.95, width: int = WIDTH, cell: int = CELL, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id and kept for every row of vectors: its links to other vectors of cosine `least` (above 0) or more.

    Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing, and so do those of different dimensions with each other.
    An id names one vector: rows repeated with one id count once and keep a row
    each; where their vectors differ, the least one in array order counts. A
    null id links with nothing, has no component and is kept. An empty table
    gives an empty table; further columns, whatever their names, are not read.
    """
    spark, radius2 = vectors.sparkSession, 2 - 2 * least
    clean = clean_vectors(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    one = clean.groupBy("id").agg(F.min("v").alias("v")).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    one = keep(one.withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), F.reverse("v"))}), "vectors")
    n = one.count()
    # A class of any size is named in rows of bounded lists.
    lists = keep(one.groupBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(1 + n // SALTED)).alias("salt")).agg(F.collect_list("id").alias("ids")), "ids")
    classes = lists.groupBy("h1", "h2").agg(F.min(F.array_min("ids")).alias("rep"), F.sum(F.size("ids").cast("long")).alias("copies"))
    named = lists.join(classes.hint("merge"), ["h1", "h2"]).select(F.explode("ids").alias("id"), "rep", "copies")

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds y, the rotated unit vector as 32-bit floats."""
        for b in batches:
            dims, y = b.column(2).to_numpy(), np.zeros(b.num_rows, object)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v = stacked(b.column(3).take(pa.array(at)), dim)
                v /= np.abs(v).max(axis=1)[:, None]  # lengths beyond the range of numbers squared
                unit = v / np.sqrt((v * v).sum(axis=1))[:, None] @ rotation(dim)
                y[at] = [x.tobytes() for x in unit.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y.tolist(), pa.binary())], ["id", "copies", "dim", "v", "y"])

    heads = one.join(classes.select(F.col("rep").alias("id"), "copies").hint("merge"), "id").select("id", "copies", "dim", "v")
    heads = keep(heads.mapInArrow(released(rotate), "id long, copies long, dim int, v array<double>, y binary"), "rotated")
    # A row for each dimension that vectors have; a bounded sample of each for its cuts.
    counts = {r["dim"]: r["n"] for r in heads.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        links = spark.createDataFrame([], "id long, n long, root long")
    else:
        links = _links(heads, counts, least, radius2, width, cell, tile)
    found = connected_components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    known = named.join(linked.hint("merge"), "rep", "left").join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    known = known.select(F.col("id").alias("own"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col))
    own = unused(rows, "own")
    out = rows.join(known.withColumnRenamed("own", own).hint("merge"), rows[id_col] == F.col(own), "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


def _links(heads: DataFrame, counts: dict[int, int], least: float, radius2: float, width: int, cell: int, tile: int) -> DataFrame:
    """(id, n, root) of the rows with links: how many vectors a tile links a row with, and the least id of the tile it is linked with by some way."""
    spaces: dict[int, list[tuple[int, int, float, int, Cells]]] = {}
    first = 0  # number of a block's first cell
    for dim, n in sorted(counts.items()):
        cells = min(CELLS, 1 << max(0, int(np.ceil(np.log2(max(1, n / cell))))))
        while cells > 1 and cells * dim > BOX_NUMBERS:
            cells //= 2
        points = np.zeros((0, dim), np.float32)
        if cells > 1:
            part = heads.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.5 * SAMPLE / n) * (1 << 30)))).select("y").limit(SAMPLE)
            points = np.asarray([np.frombuffer(r["y"], np.float32) for r in part.collect()]).reshape(-1, dim)
        spaces[dim] = []
        for begin, end in blocks_of(dim, width):
            space = Cells(points[:, begin:end], cells)
            spaces[dim].append((begin, end, radius2 * (end - begin) / dim * (1 + SLACK) + ROUNDING, first, space))
            first += len(space.low)

    def budget(g: int) -> tuple[int, int, int, float]:
        """(dimensions, number of the block, budget) of a cell's space."""
        return next((dim, k, b[2]) for dim, bs in spaces.items() for k, b in enumerate(bs) if b[3] <= g < b[3] + len(b[4].low))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(g, home, id, point): each vector's cell in each block, and the cells before it that its range reaches."""
        for b in batches:
            dims, ids = b.column(1).to_numpy(), b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                y = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.float32).reshape(-1, dim)
                code = np.rint(y * STEPS).astype(np.int8)
                for begin, end, most, base, space in spaces[dim]:
                    points = np.ascontiguousarray(y[:, begin:end])
                    home = space.home(points)
                    who, box = space.visits(points, home, most)
                    packed = [p.tobytes() + c.tobytes() for p, c in zip(points, code, strict=True)]
                    rows = np.concatenate([np.arange(len(y)), who])
                    is_home = pa.array(np.arange(len(rows)) < len(y))
                    yield pa.RecordBatch.from_arrays([pa.array(base + np.concatenate([home, box])), is_home, pa.array(ids[at][rows]), pa.array([packed[k] for k in rows.tolist()], pa.binary())], ["g", "home", "id", "point"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a tile that have a candidate in it."""
        for batch in runs(batches, 3):
            dim, block, most = budget(batch.column(0)[0].as_py())
            size = spaces[dim][block][1] - spaces[dim][block][0]
            raw = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            points, code = np.ascontiguousarray(raw[:, : 4 * size]).view(np.float32), raw[:, 4 * size :].view(np.int8)
            role = batch.column(3).to_numpy()
            left, right, upper = (role != RIGHT, role != LEFT, role[0] == BOTH)
            x, y = near(points[left], points[right], most, code[left], code[right], radius2 * (1 + SLACK) + ROUNDING, upper)
            yield batch.select([0, 1, 2, 3, 4]).take(pa.array(np.unique(np.concatenate([np.flatnonzero(left)[x], np.flatnonzero(right)[y]]))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of a tile that no earlier block has, each row's number of them with a root."""
        for batch in runs(batches, 3):
            dim, block, most = budget(batch.column(0)[0].as_py())
            role, ids, copies = (batch.column(k).to_numpy() for k in (3, 4, 5))
            v = stacked(batch.column(6), dim)
            v = v / np.abs(v).max(axis=1)[:, None]
            norm = np.sqrt((v * v).sum(axis=1))
            y = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
            left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
            linked, roots = np.zeros(len(ids), np.int64), Roots(np.arange(len(ids)))
            for a in range(0, len(left), 256):
                some = left[a : a + 256]
                cosine = (v[some] @ v[right].T) / (norm[some][:, None] * norm[right][None, :])
                p, q = np.nonzero(cosine >= least)
                p, q = some[p], right[q]
                if role[0] == BOTH:
                    p, q = p[p < q], q[p < q]
                for c in range(0, len(p), 1 << 14):
                    s, t = p[c : c + (1 << 14)], q[c : c + (1 << 14)]
                    apart = (y[s] - y[t]) ** 2
                    within = np.stack([apart[:, begin:end].sum(axis=1) <= b for begin, end, b, _, _ in spaces[dim]])
                    own = np.argmax(within, axis=0) == block  # some block is within its budget
                    s, t = s[own], t[own]
                    np.add.at(linked, s, copies[t])
                    np.add.at(linked, t, copies[s])
                    for i, j in zip(s.tolist(), t.tolist(), strict=True):
                        roots.join(i, j)
            on = np.flatnonzero(linked)
            root = np.asarray([roots.root(k) for k in on.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(linked[on]), pa.array(ids[root] if len(on) else ids[:0])], ["id", "n", "root"])

    routed = keep(heads.select("id", "dim", "y").mapInArrow(released(route), "g long, home boolean, id long, point binary"), "routed")
    sides = routed.groupBy("g").agg(*[F.ceil(F.count_if(F.col("home") == on) / tile).cast("int").alias(name) for on, name in ((True, "homes"), (False, "guests"))]).where("homes > 0")
    # A home row of chunk c meets the home chunks and all chunks of guests; a guest meets the home chunks.
    met = routed.join(sides.hint("merge"), "g")
    chunk = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    met = met.withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1)))
    apart = F.col("home") & (F.col("other") < F.col("homes"))
    i = F.when(apart, F.least("own", "other")).when(F.col("home"), F.col("own")).otherwise(F.col("other"))
    j = F.when(apart, F.greatest("own", "other")).when(F.col("home"), F.col("other")).otherwise(F.col("homes") + F.col("own"))
    role = F.when(apart & (F.col("own") == F.col("other")), BOTH).when(F.col("home") & (~apart | (F.col("own") < F.col("other"))), LEFT).otherwise(RIGHT)
    tiles = met.select("g", i.alias("i"), j.alias("j"), role.alias("role"), "id", "point")
    active = keep(in_blocks(tiles).mapInArrow(released(prune), "g long, i int, j int, role int, id long"), "active")
    whole = active.join(heads.select("id", "copies", "v", "y").hint("merge"), "id").select("g", "i", "j", "role", "id", "copies", "v", "y")
    out = keep(in_blocks(whole).mapInArrow(released(verify), "id long, n long, root long"), "links")
    discard(routed, active)
    return out


def op11_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id AS vec_id, min(root) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""
