"""Command line: python -m marginalia COMMAND --vault name=path ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from marginalia.api import Vaults
from marginalia.functions.encoder import embedded
from marginalia.settings import Settings
from marginalia.sources import backends, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia")
    p.add_argument("--vault", action="append", required=True, metavar="NAME=PATH")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("stats")
    sub.add_parser("index").add_argument("--store", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=None)
    g = sub.add_parser("graph-search")
    g.add_argument("path")
    g.add_argument("--depth", type=int, default=2)
    sub.add_parser("graph-index").add_argument("--out", required=True)
    sub.add_parser("quality")
    d = sub.add_parser("generate-dataset")
    d.add_argument("--out", required=True)
    d.add_argument("--ratio", type=float, default=5.0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("marginalia").getOrCreate()
    settings = Settings.load(spark)
    v = Vaults.read(spark, dict(x.split("=", 1) for x in a.vault))
    if a.command == "stats":
        v.list_vaults().show(truncate=False)
    elif a.command == "index":
        kept = backends.create(spark, settings.backend, a.store)
        kept.upsert(embedded(v.notes, v.encode).select("vault_name", "path", "modified", "checksum", "embedding"))
        print(kept.stats())
    elif a.command == "search":
        v.search_combined(a.query, a.limit or settings.search_limit).show(truncate=False)
    elif a.command == "graph-search":
        v.search_graph(a.path, a.depth).show(truncate=False)
    elif a.command == "graph-index":
        nodes, edges = v.graph_tables()
        nodes.write.mode("overwrite").parquet(f"{a.out}/nodes")
        edges.write.mode("overwrite").parquet(f"{a.out}/edges")
    elif a.command == "quality":
        v.quality_distribution().show(truncate=False)
    else:
        store.write_csv(v.notes_dataset().drop("last_modified"), f"{a.out}/notes")
        store.write_csv(v.pairs_dataset(a.ratio), f"{a.out}/pairs")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
