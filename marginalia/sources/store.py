"""Keyed Parquet tables: upsert, delete, lookup, statistics, migration.

Plain Parquet has no MERGE. A versioned table writes itself anew for a change
and is for tables written as a whole; a bucketed table writes only the buckets
of keys that change and names the files of each bucket in a manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.session import unused

KEY = ["vault_name", "path"]


def upserted(stored: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """stored with the rows of `changes` added or, where the key is there, put in its place. Keys of `changes` are distinct."""
    return stored.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def deleted(stored: DataFrame, keys: DataFrame, key: list[str] = KEY) -> DataFrame:
    return stored.join(keys.select(*key).distinct(), key, "left_anti")


class VersionedTable:
    """A folder of Parquet versions and their order; the last committed one is the table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path("")))
        return [n for n in names if n.startswith("v") and self._fs.exists(self._path(f"{n}/_SUCCESS"))]

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.versions()[-1]}")

    def write(self, df: DataFrame, keep_versions: int = 2) -> None:
        """Commits df as the next version; a write that fails leaves the last one in place."""
        done = self.versions()
        number = int(done[-1][1:9]) + 1 if done else 0
        df.write.parquet(f"{self.root}/v{number:08d}-{uuid.uuid4().hex[:8]}")
        for old in self.versions()[:-keep_versions]:
            self._fs.delete(self._path(old), True)

    def upsert(self, changes: DataFrame, key: list[str] = KEY) -> None:
        self.write(upserted(self.read(), changes, key) if self.exists() else changes)

    def delete(self, keys: DataFrame, key: list[str] = KEY) -> None:
        if self.exists():
            self.write(deleted(self.read(), keys, key))


@dataclass
class Manifest:
    """What a version of a bucketed table is made of: folders of each bucket, and the last batch of each feed that is in it."""

    number: int
    key: list[str]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class BucketedTable:
    """A keyed table whose rows lie in buckets by a hash of the key; a change rewrites the buckets it touches, copy on write.

    The manifest of a version is one small file, written last and never
    changed: readers see a version whole or not at all, a writer that finds its
    number taken has lost a race and raises. What comes to the driver are the
    numbers of touched buckets, at most as many as the table has. A batch of a
    feed carries the feed's name and its number; one that the table has already
    is not applied again, so a replay after a failure does no harm.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str] = KEY, buckets: int = 64, keep_versions: int = 2):
        self.spark, self.root, self.key, self.buckets, self.keep_versions = spark, root.rstrip("/"), key, buckets, keep_versions
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(folder))) if self._fs.exists(self._path(folder)) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, name: str | None = None) -> Manifest | None:
        names = [name] if name else self._manifests()
        if not names:
            return None
        text = self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def exists(self) -> bool:
        return bool(self._manifests())

    def _commit(self, m: Manifest) -> None:
        name = f"v{m.number:010d}.json"
        part, to = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{name}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(part, to):
            self._fs.delete(part, False)
            raise RuntimeError(f"another writer has committed {name}")
        self._clean()

    def _clean(self) -> None:
        """Deletes manifests beyond those that are kept, and folders of buckets that none of these names."""
        names = self._manifests()
        for old in names[: -self.keep_versions]:
            self._fs.delete(self._path(f"manifests/{old}"), False)
        used = {f for n in names[-self.keep_versions :] for f in self.manifest(n).folders.values()}
        commits = {f.split("/")[0] for f in used}
        for commit in self._names("data"):
            if commit not in commits:
                self._fs.delete(self._path(f"data/{commit}"), True)
                continue
            for bucket in self._names(f"data/{commit}"):
                if "=" in bucket and f"{commit}/{bucket}" not in used:
                    self._fs.delete(self._path(f"data/{commit}/{bucket}"), True)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
        folders = [f for b, f in m.folders.items() if buckets is None or b in buckets]
        schema = StructType.fromJson(json.loads(m.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def read(self) -> DataFrame:
        m = self.manifest()
        if m is None:
            raise ValueError(f"there is no table at {self.root}")
        return self._read(m)

    def has_batch(self, feed: str, batch: int) -> bool:
        m = self.manifest()
        return m is not None and m.applied.get(feed, -1) >= batch

    def change(self, upserts: DataFrame | None = None, keys: DataFrame | None = None, feed: str | None = None, batch: int = 0, skip_equal: list[str] | None = None) -> list[int]:
        """Puts rows in, takes the rows of `keys` out, as one version; returns the buckets written.

        Keys of upserts are distinct, and a key that is in both is put in. Rows
        that agree with the stored ones in skip_equal columns change nothing.
        A feed's batch that is in already changes nothing either.
        """
        m = self.manifest()
        if feed is not None and m is not None and m.applied.get(feed, -1) >= batch:
            return []
        if m is None:
            if upserts is None:
                return []
            m = Manifest(-1, self.key, self.buckets, upserts.schema.json())
        elif m.buckets != self.buckets or m.key != self.key:
            raise ValueError(f"the table has {m.buckets} buckets by {m.key}")
        of = lambda df: {r[0] for r in df.select(self._bucket()).distinct().collect()} if df is not None else set()
        if upserts is not None and skip_equal and m.folders:
            near = self._read(m, [str(b) for b in of(upserts)]).select(*self.key, F.struct(*skip_equal).alias("_old"))
            upserts = upserts.join(near, self.key, "left").where(F.col("_old").isNull() | ~F.struct(*skip_equal).eqNullSafe(F.col("_old"))).drop("_old")
        touched = of(upserts) | of(keys)
        if keys is not None and upserts is None:
            touched &= {int(b) for b in m.folders}
        applied = m.applied | ({feed: batch} if feed is not None else {})
        if not touched:
            if applied != m.applied:
                self._commit(replace(m, number=m.number + 1, applied=applied))
            return []
        rows = self._read(m, [str(b) for b in touched])
        if keys is not None:
            rows = deleted(rows, keys, self.key)
        if upserts is not None:
            rows = upserted(rows, upserts, self.key)
        commit, name = uuid.uuid4().hex, unused(rows, "bucket")
        # A bucket is one file: a bucket for each gigabyte or so keeps files small enough to copy.
        rows.withColumn(name, self._bucket()).repartition(name).write.partitionBy(name).parquet(f"{self.root}/data/{commit}")
        written = {n.split("=")[1]: f"{commit}/{n}" for n in self._names(f"data/{commit}") if n.startswith(f"{name}=")}
        folders = {b: f for b, f in m.folders.items() if int(b) not in touched} | written
        self._commit(replace(m, number=m.number + 1, schema=rows.schema.json(), folders=folders, applied=applied))
        return sorted(touched)

    def upsert(self, changes: DataFrame) -> list[int]:
        return self.change(upserts=changes)

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys=keys)


def _part(key: list[str], parts: int, depth: int):
    return F.pmod(F.xxhash64(F.lit(depth), *key), F.lit(parts)).cast("long")


def digests(df: DataFrame, key: list[str], parts: int, depth: int = 0) -> DataFrame:
    """part, n, digest: rows and an order-free sum of hashes of whole rows, per part of the keys' hashes at a depth."""
    columns = sorted(df.columns)
    return df.groupBy(_part(key, parts, depth).alias("part")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))


def differences(source: DataFrame, target: DataFrame, key: list[str] = KEY, parts: int = 1024, most_rows: int = 1_000_000) -> DataFrame:
    """Keys that one table lacks or where rows differ: key, in_source, in_target.

    Both tables give a digest for each part of the keys' hashes, whatever the
    order of their rows; parts whose digests agree are equal and go no further.
    The others are parted again by another hash until few rows are
    left, and only these are joined. Repeated rows count.
    """
    columns = sorted(source.columns)
    if sorted(target.columns) != columns:
        raise ValueError("the tables have different columns")
    a, b = source.select(*columns), target.select(*columns)
    for depth in range(6):
        da, db = digests(a, key, parts, depth), digests(b, key, parts, depth)
        met = da.select("part", F.col("n").alias("na"), F.col("digest").alias("da")).join(db.select("part", F.col("n").alias("nb"), F.col("digest").alias("db")), "part", "full")
        odd = {r["part"]: (r["na"] or 0) + (r["nb"] or 0) for r in met.where(~F.col("da").eqNullSafe(F.col("db")) | ~F.col("na").eqNullSafe(F.col("nb"))).collect()}  # `parts` rows at most
        part = _part(key, parts, depth)
        a, b = a.where(part.isin(list(odd))), b.where(part.isin(list(odd)))
        if sum(odd.values()) <= most_rows or len(odd) > parts // 2:
            break
    side = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"d_{name}"))
    out = side(a, "a").join(side(b, "b"), key, "full").where(~F.col("d_a").eqNullSafe(F.col("d_b")) | ~F.col("n_a").eqNullSafe(F.col("n_b")))
    return out.select(*key, F.col("n_a").isNotNull().alias("in_source"), F.col("n_b").isNotNull().alias("in_target"))


def migrated(source: DataFrame, target: DataFrame, key: list[str] = KEY) -> dict:
    """Counts after a migration, keys that are missing, extra or changed, the share that arrived unchanged, and whether all did."""
    d = differences(source, target, key).agg(
        F.coalesce(F.sum((F.col("in_source") & ~F.col("in_target")).cast("long")), F.lit(0)).alias("missing"), F.coalesce(F.sum((~F.col("in_source")).cast("long")), F.lit(0)).alias("extra"), F.coalesce(F.sum((F.col("in_source") & F.col("in_target")).cast("long")), F.lit(0)).alias("changed")
    ).first()
    n = source.select(*key).distinct().count()
    return same_counts(source, target) | d.asDict() | {"valid": not sum(d), "success_rate": 100.0 * (n - d["missing"] - d["changed"]) / n if n else 100.0}


def vault_stats(notes: DataFrame) -> DataFrame:
    """Per vault: number of notes, newest and oldest change."""
    return notes.groupBy("vault_name").agg(F.count("*").alias("notes"), F.max("modified").alias("newest"), F.min("modified").alias("oldest"))


def same_counts(source: DataFrame, target: DataFrame) -> dict:
    """Row counts after a migration, and whether they match."""
    a, b = source.count(), target.count()
    return {"source": a, "target": b, "valid": a == b, "success_rate": 100.0 * min(a, b) / a if a else 100.0}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
