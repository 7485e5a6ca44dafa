"""Stores of note vectors behind one contract, by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.search import semantic
from marginalia.sources.store import KEY, BucketedTable, deleted, upserted


class VectorStore(Protocol):
    """What every backend does; rows are (vault_name, path, embedding, ...)."""

    def upsert(self, rows: DataFrame) -> None: ...

    def get(self, vault_name: str, path: str) -> DataFrame: ...

    def delete(self, keys: DataFrame) -> None: ...

    def query(self, vector: list[float], k: int = 10, vault: str | None = None) -> DataFrame: ...

    def stats(self) -> dict[str, int]: ...


class _Table:
    """The contract over a table that can be read; similarity is one minus the cosine distance."""

    def read(self) -> DataFrame | None:
        raise NotImplementedError

    def get(self, vault_name: str, path: str) -> DataFrame:
        return self._rows().where((F.col("vault_name") == vault_name) & (F.col("path") == path))

    def query(self, vector: list[float], k: int = 10, vault: str | None = None) -> DataFrame:
        return semantic(self._rows(), vector, k, vault, metric="cosine").withColumnRenamed("score", "similarity")

    def stats(self) -> dict[str, int]:
        t = self.read()
        if t is None:
            return {"rows": 0, "vaults": 0}
        r = t.agg(F.count("*").alias("rows"), F.count_distinct("vault_name").alias("vaults")).first()
        return r.asDict()

    def _rows(self) -> DataFrame:
        t = self.read()
        if t is None:
            raise LookupError("the store is empty")
        return t


class ParquetVectors(_Table):
    """A bucketed Parquet table in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = BucketedTable(spark, root)

    def read(self) -> DataFrame | None:
        return self.table.read() if self.table.exists() else None

    def upsert(self, rows: DataFrame) -> None:
        self.table.upsert(rows)

    def delete(self, keys: DataFrame) -> None:
        self.table.delete(keys)


class ViewVectors(_Table):
    """A temporary view of the session: for tests and for tables that are made in the same job."""

    def __init__(self, spark: SparkSession, name: str = "note_vectors"):
        self.spark, self.name = spark, name

    def read(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def upsert(self, rows: DataFrame) -> None:
        old = self.read()
        (rows if old is None else upserted(old, rows, KEY)).createOrReplaceTempView(self.name)

    def delete(self, keys: DataFrame) -> None:
        if self.read() is not None:
            deleted(self.read(), keys, KEY).createOrReplaceTempView(self.name)


BACKENDS: dict[str, Callable[[SparkSession, str], VectorStore]] = {"parquet": ParquetVectors, "view": ViewVectors}


def register(name: str, make: Callable[[SparkSession, str], VectorStore]) -> None:
    if name in BACKENDS:
        raise ValueError(f"{name} is registered already")
    BACKENDS[name] = make


def create(spark: SparkSession, name: str, where: str) -> VectorStore:
    if name not in BACKENDS:
        raise ValueError(f"{name} is none of {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](spark, where)
