"""Vector tables as blocks: packed rows of many vectors that numpy works on at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, dim): rows with an id whose vector is not null or empty and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return out.withColumn("dim", F.size("v"))


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k greatest keys, ties to smaller ids."""
    if len(keys) > 4 * k:
        edge = np.partition(keys, len(keys) - k)[len(keys) - k]
        at = np.flatnonzero(keys >= edge)
    else:
        at = np.arange(len(keys))
    return at[np.lexsort((ids[at], -keys[at]))[:k]]


def ranked_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query with their ranks."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pack_groups(df: DataFrame, keys: list[str], rows: int, order: str = "id") -> DataFrame:
    """Blocks of at most `rows` vectors of one group: the keys, n, ids (binary), v (binary float64), in rows of (keys, part).

    df has the keys as integers, id, v and dim. A group whose size is not
    bounded by its keys falls into several blocks, numbered by `part`.
    """

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out(key: tuple, n: int, ids: bytes, v: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([n], pa.int64()), pa.array([ids], pa.binary()), pa.array([v], pa.binary())], [*keys, "dim", "n", "ids", "v"])

        for batch in groups:
            if not batch.num_rows:
                continue
            table_ = [batch.column(k).to_numpy().astype(np.int64) for k in range(len(keys) + 1)]
            ids = batch.column(len(keys) + 1).to_numpy()
            stack = np.stack(table_, axis=1)
            for key in np.unique(stack, axis=0):
                at = np.flatnonzero((stack == key).all(axis=1))
                name, dim = tuple(int(x) for x in key), int(key[-1])
                v = stacked(batch.column(len(keys) + 2).take(pa.array(at)), dim)
                old = held.get(name)
                got = (ids[at], v) if old is None else (np.concatenate([old[0], ids[at]]), np.concatenate([old[1], v]))
                while len(got[0]) >= rows:
                    yield out(name, rows, got[0][:rows].tobytes(), got[1][:rows].tobytes())
                    got = (got[0][rows:], got[1][rows:])
                held[name] = got
        for name, (ids, v) in held.items():
            if len(ids):
                yield out(name, len(ids), ids.tobytes(), np.ascontiguousarray(v).tobytes())

    schema = ", ".join(f"{k} long" for k in keys) + ", dim long, n long, ids binary, v binary"
    return df.select(*keys, "dim", "id", "v").mapInArrow(run, schema)


def unpack(ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(v, np.float64).reshape(len(i), -1)
