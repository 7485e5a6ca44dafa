"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped into buckets of similar length, longest first. A first
pass over the longest block gives each query a score that its k-th best cannot
fall below. Dividing it by the query's length and the greatest length of a
bucket gives the bucket's local cosine threshold: above one, nothing in it can
win and, as lengths fall, neither in any bucket after it. Else a low threshold
is met by length pruning and a high one by coordinate pruning, which keeps the
vectors whose largest query coordinates lie in the interval the threshold
leaves; the products of what remains are computed in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.vectors import best, clean_vectors, pack_groups, ranked_rows, unpack
from marginalia.session import keep, table

#: Vectors in a block, queries in a block, buckets at most.
BLOCK, QUERIES, BUCKETS = 4096, 512, 256
#: Local cosine threshold from which coordinates are pruned, and how many coordinates.
COORDINATE_FROM, COORDINATES = 0.6, 4


def _search(q: np.ndarray, q_norm: float, floor: float, own: int, ids: np.ndarray, v: np.ndarray, norms: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one block whose product is at least `floor`."""
    longest = norms[0] if len(norms) else 0.0
    if q_norm * longest == 0 or floor <= 0:
        at = np.arange(len(ids))
    else:
        local = floor / (q_norm * longest) * (1 - 1e-12)
        if local > 1:
            return ids[:0], np.zeros(0)
        at = np.arange(np.searchsorted(-norms, -floor / q_norm * (1 - 1e-12), side="right"))
        if local >= COORDINATE_FROM:
            bar = q / q_norm
            for f in np.argsort(-np.abs(bar))[:COORDINATES]:
                c = bar[f]
                spread = np.sqrt(max(0.0, (1 - local * local) * (1 - c * c)))
                low, high = c * local - spread, c * local + spread
                # A cosine above the threshold only widens what a side of 1 or -1 allows.
                low, high = (low, 1.0) if c >= local else (-1.0, high) if c <= -local else (low, high)
                x = unit[at, f]
                at = at[(x >= low - 1e-9) & (x <= high + 1e-9)]
    at = at[ids[at] != own]
    product = v[at] @ q
    take = best(ids[at], product, k)
    return ids[at][take], product[take]


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k greatest inner products of floor(scale * x) among all other vectors.

    Ties go to smaller ids. Vectors that are null or empty or hold null or
    non-finite components take no part; vectors of other dimensions than the
    query's are no candidates. A row with the query's own id is no candidate;
    other repeated rows are candidates of their own. Products are exact while
    dim * scale**2 * max(x)**2 is below 2**53. An empty table gives an empty
    table; further columns, whatever their names, are not read.
    """

    def prepared(df: DataFrame) -> DataFrame:
        out = clean_vectors(df, id_col, vector_col).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")))
        return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))

    spark = vectors.sparkSession
    candidates = prepared(vectors)
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    buckets = int(min(BUCKETS, max(1, -(-n // BLOCK))))
    # Edges by length; ties of one length are parted by the hash of their id.
    tied = candidates.withColumn("tie", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20))
    placed = tied.repartitionByRange(buckets, F.col("norm2").desc(), F.col("tie")).withColumn("bucket", F.spark_partition_id().cast("long"))
    packed = keep(pack_groups(placed.sortWithinPartitions(F.col("norm2").desc()), ["bucket"], BLOCK), "norm-buckets")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = [float((unpack(i, v)[1] ** 2).sum(axis=1).max()) ** 0.5 for i, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top, pa.float64())], ["bucket", "top"])

    # At most BUCKETS rows.
    tops = {r["bucket"]: r["top"] for r in packed.select("bucket", "ids", "v").mapInArrow(measure, "bucket long, top double").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(tops)
    falling = np.maximum.accumulate(np.asarray([tops[b] for b in order])[::-1])[::-1]  # the greatest length from here on
    lead = packed.where(F.col("bucket") == order[0]).orderBy("dim", F.xxhash64("ids")).limit(1).select("ids", "v", "dim").first()
    lead_ids, lead_v, lead_dim = bytes(lead["ids"]), bytes(lead["v"]), int(lead["dim"])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each query's floor, and the number of leading buckets that some query of the block must visit."""
        ids, v = unpack(lead_ids, lead_v)
        for b in batches:
            out: list[list] = [[], []]
            for dim, i, q in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                q_ids, q_v = unpack(i, q)
                floor = np.full(len(q_ids), -np.inf)
                if dim == lead_dim:
                    product = q_v @ v.T
                    product[q_ids[:, None] == ids[None, :]] = -np.inf
                    if product.shape[1] >= k:
                        floor = np.partition(product, product.shape[1] - k, axis=1)[:, product.shape[1] - k]
                norm = np.sqrt((q_v**2).sum(axis=1))
                least = np.where((floor > 0) & (norm > 0), floor / np.maximum(norm, 1e-300), -np.inf).min() * (1 - 1e-12)
                out[0].append(floor.tobytes())
                out[1].append(int((falling >= least).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], ["dim", "q_ids", "q_v", "floors", "visits"])

    asked = pack_groups(prepared(queries).withColumn("one", F.lit(0).cast("long")), ["one"], QUERIES).select("dim", "ids", "v")
    asked = asked.mapInArrow(floors, "dim long, q_ids binary, q_v binary, floors binary, visits long").where("visits > 0")
    asked = asked.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("visits") - 1)))
    numbers = F.create_map(*[F.lit(x).cast("long") for p in enumerate(order) for x in p])
    asked = asked.withColumn("bucket", numbers[F.col("place")]).drop("place", "visits")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_v, fl, c_ids, c_v in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                qi, qv = unpack(q_ids, q_v)
                ids, v = unpack(c_ids, c_v)
                norms = np.sqrt((v**2).sum(axis=1))
                by = np.argsort(-norms, kind="stable")
                ids, v, norms = ids[by], v[by], norms[by]
                unit = v / np.maximum(norms, 1e-300)[:, None]
                rows: list[tuple] = []
                for q, own, floor in zip(qv, qi.tolist(), np.frombuffer(fl, np.float64), strict=True):
                    found, product = _search(q, float(np.sqrt(q @ q)), float(floor), own, ids, v, norms, unit, k)
                    rows += [(own, i, int(s)) for i, s in zip(found.tolist(), product, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    joined = asked.join(packed.select("bucket", "dim", "ids", "v"), ["bucket", "dim"]).select("q_ids", "q_v", "floors", "ids", "v")
    return ranked_rows(joined.mapInArrow(probe, "query_id long, vec_id long, score long"), k)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where("vec_id % 50 = 0"), 5, 256.0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
