"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are banded; documents that share a band are candidates. A candidate
pair's signatures are compared batch by batch: after n positions with m equal,
the posterior probability that the similarity reaches the threshold (uniform
prior) is bounded, and the pair is pruned once it falls below the chosen miss
probability. What survives all batches is verified on the full shingle sets.

No row is made for a pair of a bucket. Each bucket is first linked as a star
around its least document. Where its members are in different components after
that, those outside its largest component are compared with all, in blocks of
bounded size: a block reads its members' signatures and gives back only which
components its surviving pairs would join. Components that could be joined form
a cluster, whose documents with such pairs meet once more in blocks, now with
their texts; a block verifies what survives there, pair by pair until the two
components are one, and gives back at most one link fewer than it has members.
So rows grow with members and not with pairs, and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.blocks import byte_blocks, released
from marginalia.operators.components import connected_components
from marginalia.llm.groups import BOTH, LEFT, MEMBERS, RIGHT, SIDE_BYTES, Roots, dealt, in_blocks, runs
from marginalia.llm.shingles import minhash, mix, permutations, shingle_sets
from marginalia.session import discard, keep, table

#: Bands and rows: a pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**44 = 1.6e-6.
BANDS, ROWS = 44, 6
#: Signature positions compared at a time, and the posterior below which a pair is pruned.
BATCH, MISS = 33, 1e-7
#: Bytes of text that one numpy pass makes shingles of, which takes some fifty times as much, and bytes that go to a Python worker at once.
TEXT_BYTES, BATCH_BYTES = 1 << 20, 16 << 20
#: Pairs whose first positions one numpy pass compares.
TILE = 1 << 20


def least_matches(threshold: float, total: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n positions, pairs with fewer than m equal ones are pruned.

    The posterior of the similarity is Beta(m + 1, n - m + 1); its upper tail is
    the binomial sum P(X <= m) with n + 1 draws at the threshold.
    """
    out = []
    for n in range(batch, total + 1, batch):
        log = np.concatenate([[0.0], np.cumsum(np.log((n + 1 - np.arange(n + 1)) / np.arange(1, n + 2)))])
        terms = np.exp(log + np.arange(n + 2) * np.log(threshold) + (n + 1 - np.arange(n + 2)) * np.log1p(-threshold))
        out.append((n, int(np.searchsorted(np.cumsum(terms), miss, side="left"))))
    return out


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128-bit digest of the set), bytes (of the text), sig (8 bits of each MinHash).

    Eight bits make unlike positions equal once in 256 times, which only lets
    more pairs through to the exact check.
    """
    a, b = permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in byte_blocks(batch.column(1), TEXT_BYTES):
                sets = shingle_sets(data, offsets, words)
                with np.errstate(over="ignore"):
                    s1 = np.asarray([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                    s2 = np.asarray([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                sig = [minhash(x, a, b).astype(np.uint8).tobytes() if len(x) else b"" for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array(np.diff(offsets)), pa.array(sig, pa.binary())], ["doc_id", "n", "s1", "s2", "bytes", "sig"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInArrow(released(run), "doc_id long, n long, s1 long, s2 long, bytes long, sig binary")


def banded(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id): a 64-bit key for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, bands, rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (batch.num_rows, bands))
                for k in range(rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k] + np.uint64(1))
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return sigs.select("id", "sig").mapInArrow(released(run), "key long, id long")


def survivors(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The allowed pairs of rows of two signature matrices that no batch of positions prunes."""
    xs, ys = [], []
    first, least = steps[0]
    rows = max(1, TILE // max(1, len(right)))
    other = np.ascontiguousarray(right[:, :first].T)
    for a in range(0, len(left), rows):
        part = left[a : a + rows]
        equal = np.zeros((len(part), len(right)), np.uint8)
        for k in range(first):
            equal += part[:, k, None] == other[k][None, :]
        x, y = np.nonzero((equal >= least) & allowed[a : a + rows])
        same, at = equal[x, y].astype(np.int64), first
        x += a
        for n, enough in steps[1:]:
            for b in range(0, len(x), TILE // BATCH):
                c = slice(b, b + TILE // BATCH)
                same[c] += (left[x[c], at:n] == right[y[c], at:n]).sum(axis=1)
            on = same >= enough
            x, y, same, at = x[on], y[on], same[on], n
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def block_pairs(batch: pa.RecordBatch, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, components as numbers, x, y): the surviving pairs (x, y) of rows of a block (g, i, j, role, id, component, sig, ...)."""
    role, ids = batch.column(3).to_numpy(), batch.column(4).to_numpy()
    component = np.unique(batch.column(5).to_numpy(), return_inverse=True)[1]
    left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
    if not len(left) or not len(right) or component.max() == 0:
        return ids, component, left[:0], left[:0]
    allowed = component[left][:, None] != component[right][None, :]
    if role[0] == BOTH:
        allowed &= left[:, None] < right[None, :]
    sigs = matrix(batch.column(6))
    x, y = survivors(sigs[left], sigs[right], steps, allowed)
    return ids, component, left[x], right[y]


def texts_as_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    return [s for _, _, data, offsets in byte_blocks(column, TEXT_BYTES) for s in shingle_sets(data, offsets, words)]


def alike(sets: list[np.ndarray], own: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the other sets have a Jaccard similarity of at least percent / 100 with set `own`."""
    mine, sizes = sets[own], np.asarray([len(sets[k]) for k in others])
    tokens = np.concatenate([sets[k] for k in others])
    at = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
    both = np.add.reduceat((mine[at] == tokens).astype(np.int64), np.cumsum(sizes) - sizes)
    return (both > 0) & (100 * both >= percent * (len(mine) + sizes - both))


def star_links(stars: DataFrame, heads: DataFrame, texts: DataFrame, words: int, percent: int, steps: list[tuple[int, int]]) -> DataFrame:
    """The links (a, b) among the pairs (g, id) of stars: documents and the least member of a bucket of theirs."""

    def blocks(members: DataFrame, what: DataFrame, column: str) -> DataFrame:
        """Each star's members (g, id, bytes) dealt over blocks of bounded size, its centre in each of them."""
        count = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("bytes") / SIDE_BYTES)).cast("int")
        sizes = members.groupBy("g").agg(F.greatest(F.lit(1), count).alias("n"))
        spread = members.join(sizes.hint("merge"), "g").select("g", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("j"), "id", F.lit(RIGHT).alias("role"))
        centres = sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), F.col("g").alias("id"), F.lit(LEFT).alias("role"))
        rows = spread.unionByName(centres).join(what.select("id", column).hint("merge"), "id")
        return in_blocks(rows.select("g", F.lit(0).alias("i"), "j", "role", "id", F.col("id").alias("component"), column))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 3):
            ids, _, x, y = block_pairs(batch, steps)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["g", "id"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 3):
            ids = batch.column(4).to_numpy()
            if len(ids) > 1:
                on = 1 + np.flatnonzero(alike(texts_as_sets(batch.column(6), words), 0, np.arange(1, len(ids)), percent))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), ids[0])), pa.array(ids[on])], ["a", "b"])

    left = keep(blocks(stars.withColumn("bytes", F.lit(steps[-1][0])), heads, "sig").mapInArrow(released(prune), "g long, id long"), "candidates", batch_bytes=BATCH_BYTES)
    links = keep(blocks(left.join(heads.select("id", "bytes").hint("merge"), "id"), texts, "text").mapInArrow(released(exact), "a long, b long"), "links", batch_bytes=BATCH_BYTES)
    discard(left)
    return links


def cross_links(placed: DataFrame, heads: DataFrame, texts: DataFrame, words: int, percent: int, steps: list[tuple[int, int]]) -> DataFrame:
    """Links (a, b) that join all components of placed (g, id, component, bytes) between which buckets g hold a link."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, component, other): rows with a surviving pair, and the first of the components that the block's pairs would join to theirs."""
        for batch in runs(batches, 3):
            ids, component, x, y = block_pairs(batch, steps)
            if not len(x):
                continue
            roots = Roots(np.arange(component.max() + 1))
            for a, b in np.unique(np.stack([component[x], component[y]], 1), axis=0).tolist():
                roots.join(a, b)
            active = np.unique(np.concatenate([x, y]))
            names = np.zeros(component.max() + 1, np.int64)
            names[component] = batch.column(5).to_numpy()
            other = names[[roots.root(k) for k in component[active].tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[active]), pa.array(names[component[active]]), pa.array(other)], ["id", "component", "other"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 3):
            ids, component, x, y = block_pairs(batch, steps)
            if not len(x):
                continue
            sets, roots, a, b = texts_as_sets(batch.column(7), words), Roots(np.arange(component.max() + 1)), [], []
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            edges = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own, mine = int(x[begin]), int(component[x[begin]])
                open_ = np.asarray([k for k in y[begin:end].tolist() if roots.root(int(component[k])) != roots.root(mine)], np.int64)
                for part in range(0, len(open_), 256):
                    others = open_[part : part + 256]
                    for k in others[alike(sets, own, others, percent)].tolist():
                        if roots.join(mine, int(component[k])):
                            a.append(int(ids[own]))
                            b.append(int(ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    blocks = dealt(placed).join(heads.select("id", "sig").hint("merge"), "id").select("g", "i", "j", "role", "id", "component", "sig")
    found = keep(in_blocks(blocks).mapInArrow(released(prune), "id long, component long, other long").distinct(), "candidates", batch_bytes=BATCH_BYTES)
    clusters = connected_components(found.select(F.col("component").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("g"))
    active = found.select("id", "component").distinct().join(clusters.hint("merge"), "component").join(heads.select("id", "bytes").hint("merge"), "id")
    blocks = dealt(active.select("g", "id", "component", "bytes")).join(heads.select("id", "sig").hint("merge"), "id").join(texts.hint("merge"), "id")
    links = keep(in_blocks(blocks.select("g", "i", "j", "role", "id", "component", "sig", "text")).mapInArrow(released(exact), "a long, b long"), "links", batch_bytes=BATCH_BYTES)
    discard(found)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Ids are distinct; equal rows with one id are one document and keep a row
    each, and rows with a null id are linked with nothing and kept. Null, empty
    and all-white texts have no shingles and stay alone; texts with fewer words
    than a shingle are one shingle of all their words. Documents with equal sets
    are one class and only its least id takes part in the search. Very long
    texts are read whole. An empty table gives an empty table; further columns,
    whatever their names, are not read.
    """
    steps = least_matches(percent / 100, bands * rows, BATCH, miss)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = keep(signatures(source, words, bands, rows, "id", "text"), "signatures", batch_bytes=BATCH_BYTES)
    classes = sigs.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    heads = sigs.join(classes.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "bytes", "sig")
    heads = keep(heads.dropDuplicates(["id"]), "heads")
    members = banded(heads, bands, rows)
    shared = members.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    inside = keep(members.join(shared.hint("merge"), "key"), "members", batch_bytes=BATCH_BYTES)
    texts = keep(source.join(inside.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    stars = keep(inside.where("id <> first").select(F.col("first").alias("g"), "id").distinct(), "stars")
    links = star_links(stars, heads, texts, words, percent, steps)
    found = keep(connected_components(links), "components")
    placed = inside.join(found.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high and size > 2").select("key")
    placed = placed.join(open_.hint("merge"), "key", "left_semi")
    placed = keep(placed.select(F.col("key").alias("g"), "id", "component", F.lit(bands * rows).alias("bytes")), "open")
    discard(inside, stars)
    more = cross_links(placed, heads, texts, words, percent, steps)
    components = keep(connected_components(links.unionByName(more)), "components")
    discard(placed, texts, heads, links, more, found)
    named = classes.join(components.hint("merge"), "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = sigs.select("doc_id", "n", "s1", "s2").join(named.hint("merge"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
