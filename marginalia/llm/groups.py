"""Comparing the members of groups in blocks, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members and bytes of one side of a block.
MEMBERS, SIDE_BYTES = 2048, 8 << 20
#: Roles of a row in a block: it is compared with the rows of the other side, or with both.
LEFT, RIGHT, BOTH = 0, 1, 2


def dealt(rows: DataFrame, members: int = MEMBERS, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """rows (g, id, component, bytes, ...) as rows of blocks: with i, j and role, without bytes.

    Only members of different components are to be compared. The component that
    has most members of a group is its bulk, the others are loose; both are
    dealt over blocks by a hash of the id, and each loose block meets each
    loose and each bulk block once. So a large component costs as many rows as
    it has members while the loose ones fill one block.
    """
    sizes = rows.groupBy("g", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    blocks = lambda n, b: F.greatest(F.lit(1), F.ceil(n / members), F.ceil(b / side_bytes)).cast("int")
    whole = sizes.groupBy("g").agg(F.max_by("component", F.struct("n", F.col("component"))).alias("bulk"), F.max("n").alias("n"), F.max_by("b", F.struct("n", F.col("component"))).alias("b"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count("*").alias("parts"))
    whole = whole.where("parts > 1").select("g", "bulk", blocks(F.col("n"), F.col("b")).alias("bulks"), blocks(F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")).alias("loose"))
    met = rows.join(whole.hint("merge"), "g")
    own = F.when(F.col("component") == F.col("bulk"), F.col("loose") + F.pmod(F.xxhash64("id"), F.col("bulks")).cast("int")).otherwise(F.pmod(F.xxhash64("id"), F.col("loose")).cast("int"))
    met = met.withColumn("own", own)
    # A bulk row meets every loose block; a loose row meets the loose blocks, itself included, and every bulk block.
    others = F.when(F.col("own") >= F.col("loose"), F.sequence(F.lit(0), F.col("loose") - 1)).otherwise(F.sequence(F.lit(0), F.col("loose") + F.col("bulks") - 1))
    met = met.withColumn("other", F.explode(others))
    role = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), LEFT).otherwise(RIGHT)
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("role", role)
    return met.drop("bulk", "bulks", "loose", "own", "other", "bytes")


def in_blocks(blocks: DataFrame) -> DataFrame:
    """Rows (g, i, j, role, ...) with those of one block together, its left side first."""
    return blocks.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "role", "id")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows that agree in the first `keys` integer columns, one group at a time, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        table = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(keys)])
        edges = np.concatenate([[0], np.flatnonzero((table[:, 1:] != table[:, :-1]).any(axis=0)) + 1, [n]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = tuple(table[:, a].tolist())
            if key != last and held:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


class Roots:
    """Union-find over the components met in one block."""

    def __init__(self, names: np.ndarray):
        self.of = np.arange(len(names))

    def root(self, k: int) -> int:
        while self.of[k] != k:
            self.of[k] = self.of[self.of[k]]
            k = self.of[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)
        return a != b
