"""Folders of Markdown notes as DataFrames: scan, decode, structure, search over paths."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: Folders that scans leave out unless told otherwise (fixed values).
EXCLUDED = ["Journaling", "Atlas/People", "Atlas/work People"]
IGNORED = r"(\.icloud|\.tmp|~)$|(^|/)\.DS_Store$"


def within(path: Column, prefixes: list[str]) -> Column:
    """The path is one of the prefixes or below it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def safe_relative(path: str) -> str:
    """A relative path with `.` and `..` followed; one that leaves the root is an error."""
    out: list[str] = []
    for part in PurePosixPath(path.lstrip("/")).parts:
        if part == "..":
            if not out:
                raise ValueError(f"{path!r} leaves the vault")
            out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out)


def read_vault(spark: SparkSession, root: str, vault_name: str = "default", pattern: str = "*.md", excluded: list[str] = EXCLUDED, areas: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """One row per note: vault_name, path, folder, stem, content, size, modified, checksum.

    Names that begin with a dot, excluded folders and temporary files are left
    out; `areas` keeps only what is below them. Content is UTF-8, or Latin-1
    where that is not valid.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = re.sub(r"^\w+://?", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), "^.*?" + re.escape("/" + base.lstrip("/")) + "/", "")
    out = files.select(F.lit(vault_name).alias("vault_name"), path.alias("path"), F.col("content").alias("raw"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = out.where(~F.col("path").rlike(r"(^|/)\.") & ~within(F.col("path"), excluded) & ~F.col("path").rlike(IGNORED))
    if areas is not None:
        out = out.where(within(F.col("path"), areas))
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.decode("raw", "UTF-8")).otherwise(F.decode("raw", "ISO-8859-1"))
    return out.select("vault_name", "path", folder("path").alias("folder"), stem("path").alias("stem"), text.alias("content"), "size", "modified", F.md5("raw").alias("checksum"))


def folder(path) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def write_note(spark: SparkSession, root: str, path: str, content: str) -> str:
    """Writes one note through Spark's file system, so that any store works; folders are made."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{safe_relative(path)}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return safe_relative(path)


def file_info(notes: DataFrame, path: str) -> DataFrame:
    """One note's size, time and checksum; a path that leaves the vault is an error."""
    return notes.where(F.col("path") == safe_relative(path)).select("path", "size", "modified", "checksum")


def cache_key(*parts: Column) -> Column:
    """Sixteen hexadecimal digits that stand for a call with these values."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def checksum(content: Column) -> Column:
    return F.md5(content)


def prefixes(path: Column) -> Column:
    """Every folder above a path, the nearest last."""
    parts = T.path_parts(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def structure(notes: DataFrame, max_depth: int = 2) -> DataFrame:
    """The tree to a depth: path, name, type (directory or file), depth; folders first, then by name without case."""
    folders = notes.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct().withColumn("type", F.lit("directory"))
    tree = folders.unionByName(notes.select("path", F.lit("file").alias("type")))
    tree = tree.withColumn("depth", F.size(T.path_parts(F.col("path")))).withColumn("name", F.element_at(T.path_parts(F.col("path")), -1))
    return tree.where(F.col("depth") <= max_depth).orderBy(F.col("type") == "file", F.lower("name"), "path")


def keyword_search(notes: DataFrame, query: str, search_content: bool = False, limit: int | None = 20) -> DataFrame:
    """path, match_type (name or content), preview: notes whose name or, if asked, content holds the query in any case."""
    if not query.strip():
        raise ValueError("the query is empty")
    if limit is not None and not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    low = query.lower()
    name = F.element_at(F.split("path", "/"), -1)
    at = F.instr(F.lower("content"), low)
    match = F.when(F.lower(name).contains(low), "name")
    if search_content:
        match = match.when(at > 0, "content")
    start = F.greatest(F.lit(1), at - 40)
    preview = F.when(F.col("match_type") == "content", F.col("content").substr(start, at + len(low) + 40 - start))
    out = notes.withColumn("match_type", match).where("match_type is not null").withColumn("preview", preview).select("path", "match_type", "preview")
    return out if limit is None else out.orderBy("path").limit(limit)


def folder_search(notes: DataFrame, query: str) -> DataFrame:
    """path, match_type (name or children), hits: folders whose name matches or that hold matching notes."""
    low = query.lower()
    hits = notes.select(F.explode(prefixes(F.col("path"))).alias("folder"), F.lower(F.element_at(F.split("path", "/"), -1)).contains(low).cast("int").alias("hit"))
    found = hits.groupBy("folder").agg(F.sum("hit").cast("long").alias("hits"))
    named = F.lower(F.element_at(F.split("folder", "/"), -1)).contains(low)
    return found.where(named | (F.col("hits") > 0)).select(F.col("folder").alias("path"), F.when(named, "name").otherwise("children").alias("match_type"), "hits")


def recent(notes: DataFrame, as_of, days: int = 7, limit: int = 50) -> DataFrame:
    """Notes changed within `days` before as_of, newest first, ties by path."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return notes.where(F.col("modified") > since).orderBy(F.col("modified").desc(), "path").limit(limit)


def changed(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files that are new, newer than what is stored, or have another checksum: rows of `files` with a reason."""
    old = stored.select(F.col("vault_name").alias("_v"), F.col("path").alias("_p"), F.col("modified").alias("_m"), F.col("checksum").alias("_c"))
    both = files.join(old, (F.col("vault_name") == F.col("_v")) & (F.col("path") == F.col("_p")), "left")
    reason = F.when(F.lit(force), "forced").when(F.col("_p").isNull(), "new").when(F.col("modified") > F.col("_m"), "modified").when(~F.col("checksum").eqNullSafe(F.col("_c")), "checksum")
    return both.withColumn("reason", reason).where("reason is not null").drop("_v", "_p", "_m", "_c")
