"""One call for each tool that notes are served by: search, notes, vaults, graph, quality, domains, datasets."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions import scores
from marginalia.functions.encoder import Encode, embedded, hashing_encoder
from marginalia.operators import checks, domains, features, graph, links, pairs, search, terms
from marginalia.operators import notes as note_ops
from marginalia.sources import store, vault


class Cache:
    """Results by key: the least recently used go first, and none outlives its time."""

    def __init__(self, size: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[Any, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        self.misses += 1
        value = make()
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value

    def clear(self) -> None:
        self.held.clear()

    def stats(self) -> dict[str, float]:
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / max(1, self.hits + self.misses)}


def as_markdown(title: str, frame: DataFrame, most: int = 20) -> str:
    """The first rows of a table as a Markdown section; numbers have at most four decimals."""

    def cell(v: Any) -> str:
        return (f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else ", ".join(map(cell, v)) if isinstance(v, list) else "" if v is None else str(v)).replace("|", "\\|")

    rows = [[cell(v) for v in r] for r in frame.limit(most).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"## {title.capitalize()}", "", line(frame.columns), line(["---"] * len(frame.columns)), *map(line, rows)])


class Vaults:
    """Notes with vectors and edges, and the tools over them. Frames are read when a tool is called."""

    def __init__(self, notes: DataFrame, encode: Encode | None = None, as_of: str | None = None):
        self.notes, self.encode, self.as_of = notes, encode or hashing_encoder(), as_of
        self.cache = Cache()

    @classmethod
    def read(cls, spark: SparkSession, roots: dict[str, str], **options: Any) -> Vaults:
        frames = [vault.read_vault(spark, root, name) for name, root in roots.items()]
        if not frames:
            raise ValueError("no vaults")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return cls(out, **options)

    def parsed(self) -> DataFrame:
        return self.cache.get("parsed", lambda: M.parsed(self.notes))

    def vectors(self) -> DataFrame:
        return self.cache.get("vectors", lambda: embedded(self.notes, self.encode))

    def links(self) -> DataFrame:
        return self.cache.get("links", lambda: links.resolved(links.extracted(self.notes), self.notes))

    def edges(self) -> DataFrame:
        return links.edges(self.links())

    def search_semantic(self, query: str, limit: int = 10, vault_name: str | None = None, threshold: float | None = None, metric: str = "neg_l2") -> DataFrame:
        if not query.strip() or not 1 <= limit <= 50:
            raise ValueError("a query and a limit from 1 to 50 are needed")
        return search.semantic(self.vectors().select("vault_name", "path", "embedding"), self.encode([query])[0].tolist(), limit, vault_name, threshold, metric)

    def search_vault(self, query: str, search_content: bool = False, limit: int = 20) -> DataFrame:
        return vault.keyword_search(self.notes, query, search_content, limit)

    def search_combined(self, query: str, limit: int = 10, per_folder: int = 3) -> DataFrame:
        s = self.search_semantic(query, min(50, 2 * limit)).select("path", "score")
        k = vault.keyword_search(self.notes, query, True, 2 * limit).select("path", "match_type")
        fused = search.diversified(search.fused(s, k, query), vault.folder("path"), per_folder)
        return fused.orderBy(F.col("unified_score").desc(), "path").limit(limit)

    def search_graph(self, path: str, depth: int = 2) -> DataFrame:
        """Neighbours of a note; for a path that is none, notes like it by keyword and meaning."""
        known = self.notes.where(F.col("path") == path).limit(1).count()
        if known:
            return graph.neighbourhood(self.edges(), path, depth)
        found = self.search_semantic(path, 5).select("path").unionByName(vault.keyword_search(self.notes, path, True, 5).select("path")).distinct()
        return found.select(F.col("path").alias("id"), F.lit(None).cast("int").alias("distance"), F.lit(False).alias("is_center"))

    def read_note(self, vault_name: str, path: str) -> DataFrame:
        return self.notes.where((F.col("vault_name") == vault_name) & (F.col("path") == vault.safe_relative(path)))

    def list_vaults(self) -> DataFrame:
        return store.vault_stats(self.notes)

    def health(self) -> dict[str, bool]:
        try:
            return {"spark": self.notes.sparkSession.range(1).count() == 1, "notes": not self.notes.isEmpty()}
        except Exception:
            return {"spark": False, "notes": False}

    def _as_of(self) -> Any:
        return self.as_of if self.as_of is not None else time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())

    def assess_quality(self) -> DataFrame:
        nodes = self.notes.select(F.col("path").alias("id")).distinct()
        lost = self.links().where("source <> target").select(F.col("source").alias("src"), F.col("target").alias("dst"))
        return note_ops.assess(self.notes, self._as_of(), note_ops.connection_metrics(nodes, lost))

    def quality_distribution(self) -> DataFrame:
        return self.assess_quality().groupBy("level").agg(F.count("*").alias("notes"), F.avg("overall").alias("mean_score"))

    def context(self) -> dict[str, DataFrame]:
        return {"organisation": note_ops.organisation(self.notes), "depth": note_ops.depth_metrics(self.notes), "clusters": note_ops.directory_clusters(self.notes), "folders": note_ops.folder_hierarchy(self.notes), "quality": self.quality_distribution(), "links": links.statistics(self.links(), self.notes)}

    def analyze_domains(self, similarity: float = 0.7) -> dict[str, DataFrame]:
        v = self.vectors().select(F.col("path").alias("id"), "embedding")
        members = domains.density_clusters(v, similarity).where("cluster is not null")
        labels = members.select("id", F.col("cluster").alias("domain"))
        keys = domains.cluster_keywords(members.join(self.notes.select(F.col("path").alias("id"), "path", "content"), "id"))
        sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
        return {"members": members, "centroids": domains.centroids(members.join(v, "id").select("cluster", "embedding")), "connections": domains.domain_edges(self.edges(), labels), "bridges": domains.bridge_opportunities(keys.join(sizes, "cluster").select(F.col("cluster").alias("domain"), "n", "keywords"))}

    def graph_tables(self) -> tuple[DataFrame, DataFrame]:
        return links.graph_tables(self.parsed())

    def report(self, most: int = 20) -> str:
        """The vault's context and recommendations as Markdown, at most so many rows of each part."""
        advice = [f"- {r['title']} ({r['priority']})" for r in self.recommendations()]
        return "\n\n".join(["# Vault context", *(as_markdown(name, frame, most) for name, frame in self.context().items()), "## Recommendations", "\n".join(advice) or "none"])

    def validate(self, confined_to: str | None = None) -> dict:
        return checks.vault(self.notes, confined_to)

    def recommendations(self, limit: int = 5) -> list[dict]:
        return note_ops.recommendations(note_ops.organisation(self.notes).first()["confidence"], note_ops.quality_gaps(self.assess_quality()), limit)

    def notes_dataset(self) -> DataFrame:
        """One row a note: parsed counts, summary, front matter, degrees and centralities, text features, top terms and topic."""
        nodes = self.notes.select(F.col("path").alias("id")).distinct()
        e = self.edges().select("src", "dst")
        metrics = graph.degrees(nodes, e).select("id", F.col("in_degree").alias("incoming_links_count"))
        metrics = metrics.join(graph.betweenness(e, nodes).withColumnRenamed("betweenness", "betweenness_centrality"), "id").join(graph.path_metrics(e, nodes).select("id", F.col("closeness").alias("closeness_centrality")), "id")
        metrics = metrics.join(graph.pagerank(nodes, e, 100, tolerance=1e-6).withColumnRenamed("rank", "pagerank_score"), "id").join(graph.clustering(e).select("id", F.col("coefficient").alias("clustering_coefficient")), "id", "left")
        rows = self.parsed().withColumn("content", F.col("body")).withColumnRenamed("frontmatter", "fields")
        out = features.note_features(rows, metrics)
        text = note_ops.content_features(rows.select(F.col("path").alias("id"), "content"), "content").select("id", "sentiment_score", "sentiment_label", "readability_score", F.col("grade_level").alias("readability_grade"), "content_type", "complexity_score", "vocabulary_richness")
        out = out.join(text, "id")
        found = terms.documents(rows, "path", "content")
        n = rows.count()
        vocab = terms.vocabulary(found, n)
        w, size = terms.weights(found, vocab), max(1, vocab.count())
        top = terms.top_terms(w).groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "term", "weight")))).alias("top_tfidf_terms"))
        per = w.groupBy("id").agg((F.sum("weight") / size).alias("avg_tfidf_score"), (F.count("*") / size).alias("tfidf_vocabulary_richness"))
        out = out.join(top, "id", "left").join(per, "id", "left").na.fill({"avg_tfidf_score": 0.0, "tfidf_vocabulary_richness": 0.0, "top_tfidf_terms": "[]"})
        return out.withColumn("semantic_cluster_id", F.lit(-1))

    def pairs_dataset(self, ratio: float = 5.0, most_per_note: int = 50, seed: int = 42) -> DataFrame:
        """Linked pairs and seeded negatives with their features and link_exists."""
        e = self.edges()
        yes = pairs.positives(e)
        n = self.parsed().select(F.col("path").alias("id"), "path", F.col("stem").alias("title"), "content", F.col("modified").alias("created"), "tags", F.lit("unknown").alias("quality_stage")).join(self.vectors().select(F.col("path").alias("id"), "embedding"), "id")
        wanted = pairs.target_negatives(yes.count(), n.count(), ratio)
        no = pairs.stratified_negatives(n, n.select("id", vault.folder("path").alias("group")), n.select("id", F.explode("tags").alias("group")), yes, wanted, seed)
        both = yes.withColumn("link_exists", F.lit(True)).unionByName(no.withColumn("link_exists", F.lit(False)))
        kept = pairs.capped(both, most_per_note, seed)
        out = pairs.pair_features(kept, n)
        near = graph.common_neighbours(e, kept.select("a", "b"))
        steps = graph.shortest_paths(e.select("src", "dst"), kept.select("a", "b"))
        found = terms.documents(n, "id", "content")
        alike = terms.pair_cosine(terms.weights(found, terms.vocabulary(found, n.count())), kept)
        out = out.join(near, ["a", "b"]).join(steps, ["a", "b"]).join(alike, ["a", "b"])
        return out.withColumn("combined_similarity", scores.combined_similarity(F.col("cosine_similarity"), F.col("tfidf_similarity")))
