"""The registry of named queries, and the note and edge views they share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import graph
from marginalia.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The day that ages are counted to, so that results do not change with the clock.
AS_OF = "2024-02-01 00:00:00"


def query(name: str, sql: str | None = None):
    """Registers a query and, if given, the SQL that must return the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of documents, for costly work on the texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: a vault for each source, a folder for each language."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", F.col("source").alias("vault_name"), F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".md"))).alias("path"), F.concat_ws("/", "source", "lang").alias("folder"),
        F.concat(F.lit("doc_"), "doc_id").alias("stem"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"),
        F.expr(f"timestamp'{AS_OF}' - make_interval(0, 0, 0, cast(doc_id * 7 % 900 as int))").alias("modified"), F.md5("text").alias("checksum"), "lang", "source",
    )


NOTES = f"""notes AS (SELECT doc_id, source AS vault_name, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, source || '/' || lang AS folder, 'doc_' || doc_id AS stem, text AS content,
  strlen(text)::BIGINT AS size, TIMESTAMP '{AS_OF}' - to_days((doc_id * 7 % 900)::INTEGER) AS modified, md5(text) AS checksum, lang, source FROM documents)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes whose content has front matter, a heading and links around the text."""
    n = notes(spark, sf_dir)
    d = F.col("doc_id")
    summary = F.when(d % 3 == 0, F.concat(F.lit("summary: About "), d, F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("---\ntags: ["), "lang", F.lit(", 🌱]\naliases: a"), d, F.lit(", b\nup: n"), d % 7, F.lit("\nsimilar: [x, y]\n"), summary, F.lit("---\n# Title "), d, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\nSee [[doc_"), d + 20, F.lit("|next]] and [page](https://x.org/a).\n"))
    return n.withColumn("content", content)


MARKED = NOTES + """, marked AS (SELECT * REPLACE ('---' || chr(10) || 'tags: [' || lang || ', 🌱]' || chr(10) || 'aliases: a' || doc_id || ', b' || chr(10) || 'up: n' || doc_id % 7 || chr(10) || 'similar: [x, y]' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'summary: About ' || doc_id || chr(10) ELSE '' END
  || '---' || chr(10) || '# Title ' || doc_id || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || 'See [[doc_' || doc_id + 20 || '|next]] and [page](https://x.org/a).' || chr(10) AS content) FROM notes)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed part graph: the part of each line of an order to that of the next line."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src")), l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


SPARSE = """sparse AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey)"""
#: Undirected views of the CTE `dense` (src < dst).
BOTH = """both_ AS (SELECT src, dst FROM dense UNION SELECT dst, src FROM dense),
deg AS (SELECT src AS id, count(*) AS k FROM both_ GROUP BY src)"""
#: The part graph without directions.
PARTS = f"{SPARSE}, dense AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM sparse), {BOTH}"


#: The part graph with its directions.
LINKS = f"{SPARSE}, dense AS (SELECT src, dst FROM sparse), {BOTH}"


def kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed customer graph: each customer to the one with the next balance in the nation, and to the next in the nation and market segment.

    Sparse at any size: a component for each nation, two to four neighbours each.
    """
    c = table(spark, sf_dir, "customer")
    found = None
    for place in (["c_nationkey"], ["c_nationkey", "c_mktsegment"]):
        order = [*place, "c_acctbal", "c_custkey"]
        rows = c.select(*order, F.struct(F.struct(*place).alias("place"), F.col("c_custkey").alias("id")).alias("node"))
        next_ = graph.succession(rows, order, "node").where("src.place = dst.place").select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"))
        found = next_ if found is None else found.unionByName(next_)
    return found.distinct()


KIN = """kin AS (SELECT DISTINCT src, dst FROM (SELECT c_custkey AS src, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS dst FROM customer
  UNION ALL SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) FROM customer) WHERE dst IS NOT NULL)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who are next to each other in kin(), undirected: src < dst."""
    return kin(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


DENSE = f"{KIN}, dense AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM kin), {BOTH}"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and label of customers: their market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def six(c, name: str):
    return F.round(c, 6).alias(name)
