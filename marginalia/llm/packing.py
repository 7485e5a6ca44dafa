"""Best-fit packing with large-item matching.

Pieces above a third of the capacity can share a sequence with at most one
other of them: greedy matching pairs the largest with the largest that fits.
Smaller pieces then best-fit the remaining gaps, longest first. The plan is
made over the histogram of lengths, which has at most `capacity` rows whatever
the corpus holds; pieces get their places by their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marginalia.llm.blocks import released, text_slices
from marginalia.llm.bpe import loaded, texts_of, vocabulary
from marginalia.session import keep, table

CAPACITY = 4096
#: The id that ends each document.
END_ID = 1
#: Rows of one length are ranked in this many groups at least, one more for each RANK_ROWS rows.
RANK_GROUPS, RANK_ROWS = 64, 500_000


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): a run of equal pieces, one in each of `count` sequences.

    Steps work on whole runs, so the cost follows the distinct lengths and not the pieces.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    runs: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that some sequence has, ascending
    sequences = 0

    def place(n: int, count: int, first: int, offset: int) -> None:
        runs.append((n, ranks[n], count, first, offset))
        ranks[n] += count
        left[n] -= count

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), 0)
            count = min(left[n], left[mate]) if mate and mate != n else left[n] // 2 if mate else left[n]
            place(n, count, sequences, 0)
            if mate:
                place(mate, count, sequences, n)
            free(capacity - n - mate, sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, bins = gaps[gap].pop()
                count = min(bins, left[n])
                place(n, count, first, capacity - gap)
                if bins > count:
                    gaps[gap].append((first + count, bins - count))
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                free(gap - n, first, count)
                continue
            each = capacity // n
            count = max(1, left[n] // each)
            for k in range(min(each, left[n])):
                place(n, count, sequences, k * n)
            free(capacity - runs[-1][4] - n, sequences, count)
            sequences += count
    return runs


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    Null and empty texts are one piece that holds the end id alone. Only
    documents longer than the capacity are cut; the last piece may be shorter.
    """
    columns = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(path), np.asarray([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in text_slices(whole, 1):
                out: list[list] = [[] for _ in columns]
                for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts_of(batch.column(1))), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, columns.values(), strict=True)], list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` between 1 and the capacity.

    Every row gets one place and offsets are gapless from 0. Rows that are equal
    in `order` (repeated ids) get places of their own in any order. An empty
    table gives an empty table. `pieces` is read twice, so pass a written table.

    The histogram has at most `capacity` rows. Ranks among equal lengths are
    counted in hashed groups, so one length with most of the rows is spread
    over tasks; the groups' sums give each its first rank.
    """
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    runs = sorted(plan_packing(histogram, capacity))
    groups = max(RANK_GROUPS, sum(histogram.values()) // RANK_ROWS)
    length, rank, _, first, offset = (np.asarray([r[k] for r in runs], np.int64) for k in range(5))
    shared = pieces.sparkSession.sparkContext.broadcast((length, rank, first, offset, (length << 44) + rank))
    names = pieces.columns
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sums = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select("length", "_group", F.coalesce("_base", F.lit(0).cast("long")).alias("_base"))
    ranked = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(sums, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_base")).select(*names, "_rank")
    where_length, where_rank = names.index("length"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, firsts, offsets, keys = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n, r = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (where_length, where_rank))
            at = np.searchsorted(keys, (n << 44) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(firsts[at] + r - ranks[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(released(run), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises, cuts and packs documents; the pieces are written to the shared folder once.

    Null text counts as empty and has the one end token. Every row is a
    document of its own, repeated ids included; very long texts are cut into
    pieces of the capacity, nothing is dropped. An empty table gives an empty
    table; further columns, whatever their names, are not read.
    """
    return pack_pieces(keep(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)
