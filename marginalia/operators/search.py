"""Vector, keyword and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scores, vectors
from marginalia.session import in_turn, keep


def vector_scores(notes: DataFrame, query: list[float], metric: str = "neg_l2") -> DataFrame:
    """Adds `score`: minus the distance, or the cosine."""
    if metric not in ("neg_l2", "cosine"):
        raise ValueError("metric is neg_l2 or cosine")
    q = F.array(*[F.lit(float(x)) for x in query])
    return notes.withColumn("score", (vectors.negative_l2 if metric == "neg_l2" else vectors.cosine)(F.col("embedding"), q))


def semantic(notes: DataFrame, query: list[float], k: int = 10, vault: str | None = None, threshold: float | None = None, metric: str = "neg_l2", key: str = "path") -> DataFrame:
    """The k nearest notes; a vault filters before, the threshold after the k are found."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if vault is not None:
        notes = notes.where(F.col("vault_name") == vault)
    out = vector_scores(notes, query, metric).drop("embedding").orderBy(F.col("score").desc(), key).limit(k)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def per_group(notes: DataFrame, query: list[float], group: str, k: int = 10, metric: str = "neg_l2", key: str = "path") -> DataFrame:
    """The k nearest of each group."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), key)
    return vector_scores(notes, query, metric).drop("embedding").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged(semantic_hits: DataFrame, keyword_hits: DataFrame, limit: int = 10) -> DataFrame:
    """Both lists of (path, ...), a path once with semantic before keyword: semantic by score, then keyword by path."""
    both = semantic_hits.select("path", F.lit("semantic").alias("match"), F.col("score")).unionByName(keyword_hits.select("path", F.lit("keyword").alias("match"), F.lit(None).cast("double").alias("score")))
    first = both.groupBy("path").agg(F.max_by(F.struct("match", "score"), F.struct(F.col("match") == "semantic", "score")).alias("b")).select("path", "b.*")
    return first.orderBy(F.when(F.col("match") == "semantic", 0).otherwise(1), F.col("score").desc_nulls_last(), "path").limit(limit)


def fused(semantic_hits: DataFrame, keyword_hits: DataFrame, query: str) -> DataFrame:
    """path, semantic_score, keyword_score, unified_score of (path, score) and (path, match_type)."""
    s = semantic_hits.groupBy("path").agg(F.max("score").alias("raw")).select("path", scores.normalised_semantic(F.col("raw")).alias("semantic_score"))
    w = keyword_hits.select("path", scores.keyword_score(F.col("match_type"), F.col("path"), query).alias("s")).groupBy("path").agg(F.max("s").alias("keyword_score"))
    return s.join(w, "path", "full_outer").withColumn("unified_score", scores.unified(F.col("semantic_score"), F.col("keyword_score")))


def diversified(hits: DataFrame, folder: Column, per_folder: int = 3, always: float = 0.8, score: str = "unified_score") -> DataFrame:
    """At most `per_folder` hits of a folder, but every hit whose score is above `always`."""
    w = Window.partitionBy(folder).orderBy(F.col(score).desc(), "path")
    return hits.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= per_folder) | (F.col(score) > always)).drop("_rn")


#: Pivots that blocks of vectors are bounded by, and the slack of the bounds.
PIVOTS, SLACK = 64, 1e-9
#: Pairs of blocks that meet at a time at least.
STRIP = 256


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def products(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows of x, rows of y, product) of unit vectors whose product reaches the threshold, and how many numbers were multiplied.

    The first half of the dimensions is multiplied for all pairs. What the rest
    can add is at most the product of the lengths of what is left of both, so
    only pairs that can still reach the threshold are multiplied to the end.
    """
    h = max(1, x.shape[1] // 2)
    rest_x, rest_y = (np.sqrt((v[:, h:] ** 2).sum(axis=1)) for v in (x, y))
    some = x[:, :h] @ y[:, :h].T
    at, to = np.nonzero(some + np.outer(rest_x, rest_y) >= threshold - SLACK)
    value = some[at, to]
    for k in range(0, len(at), 1 << 16):
        c = slice(k, k + (1 << 16))
        value[c] += np.einsum("ij,ij->i", x[at[c], h:], y[to[c], h:])
    on = value >= threshold
    return at[on], to[on], value[on], len(x) * len(y) * h + len(at) * (x.shape[1] - h)


def similar_pairs(notes: DataFrame, threshold: float, id_col: str = "id", block: int = 2048, pivots: int = PIVOTS) -> DataFrame:
    """a < b, similarity: all pairs whose cosine is at least the threshold.

    Vectors are dealt to the nearest of some pivots, at most `pivots` of them
    taken by hash, and the cells are cut into hashed blocks. A block knows the
    least and greatest angle of its vectors to every pivot, and by the triangle
    inequality two blocks hold no pair if these ranges are further apart than
    the threshold's angle for some pivot: such blocks never meet. Those that do
    are multiplied as matrices, the second half of the dimensions only where
    the first leaves a chance. Only pairs that reach the threshold become rows
    and no task holds more than two blocks. Null and zero vectors have no
    pairs, nor have vectors of different lengths.
    """
    kind, far = dict(notes.dtypes)[id_col], float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-7
    v = notes.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), vectors.normalised(F.col("embedding")).alias("v")).withColumn("dim", F.size("v")).where("dim > 0")
    v = v.where(F.exists("v", lambda x: x != 0))
    n = v.count()
    sample = v.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, 2 * pivots / max(1, n)) * (1 << 30))).select("dim", "v").limit(2 * pivots).collect()
    chosen: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in sample}:
        chosen[dim] = np.asarray([r["v"] for r in sample if r["dim"] == dim][:pivots])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the number of the nearest pivot."""
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in chosen:
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                    cell[at] = np.argmax(x @ chosen[dim].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "v", "dim", "cell"])

    placed = keep(v.mapInArrow(place, f"id {kind}, v array<double>, dim int, cell int"), "placed")
    # At most `pivots` rows for each length that vectors have.
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    parts = sizes.withColumn("parts", F.ceil(F.col("n") / block).cast("long")).select("dim", "cell", "parts")
    dealt = placed.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = dealt.groupBy("dim", "cell", "part").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("x"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the least and greatest angles to each pivot."""
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                dim = one.column(0)[0].as_py()
                x = one.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                a = angles(x, chosen[dim]) if dim in chosen else np.zeros((len(x), 0))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([a.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([a.max(axis=0).tolist()], pa.list_(pa.float64()))], ["dim", "cell", "part", "ids", "x", "low", "high"])

    blocks = keep(blocks.select("dim", "cell", "part", "ids", "x").mapInArrow(bound, f"dim int, cell int, part long, ids array<{kind}>, x array<double>, low array<double>, high array<double>"), "blocks", rows_per_file=64)
    key, side = F.struct("cell", "part"), lambda k: blocks.select("dim", key.alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"))
    salts = int(min(1024, max(1, n // block // 8)))
    met = side("i").withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int")).join(side("j").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["dim", "salt"]).where("i <= j")
    apart = lambda low, high: F.exists(F.zip_with(low, high, lambda x, y: x - y > far), lambda x: x)
    met = keep(met.where(~apart(F.col("low_i"), F.col("high_j")) & ~apart(F.col("low_j"), F.col("high_i"))).select("dim", "i", "j"), "met")
    matrix = lambda k: blocks.select("dim", key.alias(k), F.col("ids").alias(f"ids_{k}"), F.col("x").alias(f"x_{k}"))
    # A block is copied for each block it meets: as many pairs at a time as copy about the table once.
    strips = max(1, -(-met.count() // max(STRIP, blocks.count())))

    def strip(s: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("i"), F.lit(strips)) == s
        both = met.where(mine).join(matrix("i").where(mine).hint("merge"), ["dim", "i"]).join(matrix("j").hint("merge"), ["dim", "j"])
        return both.select("dim", (F.col("i") == F.col("j")).alias("own"), "ids_i", "x_i", "ids_j", "x_j").mapInArrow(multiply, f"a {kind}, b {kind}, similarity double")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                dim, own = one.column(0)[0].as_py(), one.column(1)[0].as_py()
                x_ids, y_ids = one.column(2).flatten(), one.column(4).flatten()
                x, y = (one.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (3, 5))
                for i in range(0, len(x), 256):
                    at, to, value, _ = products(x[i : i + 256], y, threshold)
                    if own:
                        on = at + i < to
                        at, to, value = at[on], to[on], value[on]
                    a, b = x_ids.take(pa.array(at + i)), y_ids.take(pa.array(to))
                    less = pc.less(a, b)
                    yield pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(value)], ["a", "b", "similarity"])

    return strip(0) if strips == 1 else in_turn(map(strip, range(strips)), "similar")


#: Raw scores above which a match by meaning is told as high or medium.
HIGH, MEDIUM = -2.0, -5.0


def snippet(semantic_score: Column, keyword_score: Column, match_type: Column) -> Column:
    """Why a hit was found, in words."""
    by_meaning = F.when(semantic_score.isNotNull(), F.concat(F.lit("semantic similarity: "), F.when(semantic_score > HIGH, "high").when(semantic_score > MEDIUM, "medium").otherwise("low")))
    by_word = F.when(keyword_score.isNotNull() & match_type.isNotNull(), F.concat(match_type, F.lit(" match")))
    return F.concat(F.lit("Found via: "), F.concat_ws(", ", by_meaning, by_word))


def graph_augmented(notes: DataFrame, edges: DataFrame, query: list[float], k: int = 3, metric: str = "cosine", key: str = "path") -> DataFrame:
    """The k nearest notes with what they are linked to, tags left out: key, score, rel_type, dst; a note without links has one row of nulls."""
    top = semantic(notes, query, k, metric=metric, key=key).select(key, "score")
    out = edges.where("rel_type <> 'HAS_TAG'").select(F.col("src").alias(key), "rel_type", "dst").distinct()
    return top.join(out, key, "left")
