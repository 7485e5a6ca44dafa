"""Knowledge domains: clusters of note vectors, links between domains, bridges that could be made."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.operators.graph import components
from marginalia.operators.search import similar_pairs
from marginalia.session import keep


def density_clusters(notes: DataFrame, similarity: float = 0.7, least: int = 3) -> DataFrame:
    """id, cluster: density clustering by cosine. Core notes have `least` notes within reach, themselves included; the rest join the least core near them or none (null)."""
    near = keep(similar_pairs(notes, similarity).select("a", "b"), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy("a").agg((F.count("*") + 1).alias("k")).where(F.col("k") >= least).select(F.col("a").alias("id"))
    inner = both.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = components(core, inner)
    edge = both.join(core.withColumnRenamed("id", "a"), "a", "left_anti").join(groups.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("cluster"))
    found = groups.select("id", F.col("component").alias("cluster")).unionByName(edge)
    return notes.select("id").join(found, "id", "left")


def domain_clusters(notes: DataFrame, similarity: float = 0.7, least: int = 3, most: int = 10, seed: int = 42) -> DataFrame:
    """id, cluster of the domains: density clusters; where those are fewer than two, clusters by means of all notes as well, so that a note may be in one of each kind."""
    found = keep(density_clusters(notes, similarity, least).where("cluster is not null").select("id", F.concat(F.lit("density_"), F.col("cluster").cast("string")).alias("cluster")), "clusters")
    if found.select("cluster").distinct().limit(2).count() > 1:
        return found
    n = notes.count()
    k = min(most, max(2, n // 10))
    if n < 2:
        return found
    rows = notes.select("id", array_to_vector(V.normalised(F.col("embedding"))).alias("features"))
    groups = KMeans(k=k, seed=seed, maxIter=50).fit(rows).transform(rows).select("id", F.concat(F.lit("means_"), F.col("prediction").cast("string")).alias("cluster"))
    large = groups.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster")
    return found.unionByName(groups.join(large, "cluster", "left_semi").select("id", "cluster"))


def centroids(members: DataFrame) -> DataFrame:
    """cluster, n, centroid, coherence: means of (cluster, embedding); coherence is the mean cosine of pairs, from the length of the sum of unit vectors."""
    u = members.select("cluster", F.posexplode("embedding").alias("pos", "x"), V.norm(F.col("embedding")).alias("l"))
    per = u.groupBy("cluster", "pos").agg(F.avg("x").alias("mean"), F.sum(F.when(F.col("l") > 0, F.col("x") / F.col("l")).otherwise(0.0)).alias("unit"), F.count("*").alias("n"))
    g = per.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centroid"), F.sum(F.col("unit") * F.col("unit")).alias("s"))
    n = F.col("n")
    return g.select("cluster", "n", "centroid", F.when(n > 1, (F.col("s") - n) / (n * (n - 1))).otherwise(1.0).alias("coherence"))


def domain_edges(edges: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """from_domain, to_domain, connections, bridge_notes (first five by name), strength, connection_type between different domains."""
    a, b = labels.select(F.col("id").alias("src"), F.col("domain").alias("d1")), labels.select(F.col("id").alias("dst"), F.col("domain").alias("d2"))
    sizes = labels.groupBy("domain").agg(F.count("*").alias("n"))
    met = edges.select("src", "dst").join(a, "src").join(b, "dst").where("d1 <> d2").select(F.least("d1", "d2").alias("d1"), F.greatest("d1", "d2").alias("d2"), "src", "dst")
    count = met.groupBy("d1", "d2").agg(F.count("*").alias("connections")).where(F.col("connections") >= least)
    ends = met.select("d1", "d2", F.explode(F.array("src", "dst")).alias("note")).distinct()
    n_bridges = ends.groupBy("d1", "d2").agg(F.count("*").alias("bridges"))
    five = ends.withColumn("rn", F.row_number().over(Window.partitionBy("d1", "d2").orderBy("note"))).where("rn <= 5").groupBy("d1", "d2").agg(F.array_sort(F.collect_list("note")).alias("bridge_notes"))
    out = count.join(n_bridges, ["d1", "d2"]).join(five, ["d1", "d2"]).join(sizes.select(F.col("domain").alias("d1"), F.col("n").alias("n1")), "d1").join(sizes.select(F.col("domain").alias("d2"), F.col("n").alias("n2")), "d2")
    strength = F.least(F.lit(1.0), F.col("connections") / F.greatest(F.lit(1.0), 0.1 * F.col("n1") * F.col("n2")))
    kind = F.when(F.col("bridges") > 5, "hierarchical").when(F.col("bridges") > 2, "associative").otherwise("sequential")
    return out.select(F.col("d1").alias("from_domain"), F.col("d2").alias("to_domain"), "connections", "bridge_notes", strength.alias("strength"), kind.alias("connection_type"))


def cluster_keywords(members: DataFrame, k: int = 8) -> DataFrame:
    """cluster, keywords: the commonest words longer than two letters of (cluster, path, content), names before content."""
    parts = lambda c: F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda w: F.length(w) > 2)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    words = members.select("cluster", F.explode(parts(stem)).alias("word"), F.lit(0).alias("part")).unionByName(members.select("cluster", F.explode(parts(F.coalesce("content", F.lit("")))).alias("word"), F.lit(1).alias("part")))
    counted = words.groupBy("cluster", "part", "word").agg(F.count("*").alias("n"))
    best = counted.withColumn("rn", F.row_number().over(Window.partitionBy("cluster", "part").orderBy(F.col("n").desc(), "word"))).where("(part = 0 and rn <= 10) or (part = 1 and rn <= 5)")
    once = best.groupBy("cluster", "word").agg(F.min(F.struct("part", "rn")).alias("at"))
    return once.groupBy("cluster").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), 1, k).alias("keywords"))


def bridge_opportunities(domains: DataFrame, limit: int = 10) -> DataFrame:
    """Pairs of (domain, n, keywords) whose keywords overlap, the most alike first, with a rationale."""
    a, b = domains.select(F.col("domain").alias("d1"), F.col("keywords").alias("k1"), F.col("n").alias("n1")), domains.select(F.col("domain").alias("d2"), F.col("keywords").alias("k2"), F.col("n").alias("n2"))
    # Domains that share a keyword meet on it; the others have similarity 0 anyway.
    met = a.select("*", F.explode("k1").alias("w")).join(b.select("*", F.explode("k2").alias("w")), "w").where("d1 < d2").drop("w").distinct()
    s = met.withColumn("similarity", T.jaccard(F.col("k1"), F.col("k2"))).withColumn("shared", F.array_sort(F.array_intersect("k1", "k2")))
    priority = F.when(F.col("similarity") > 0.5, "high").when(F.col("similarity") > 0.3, "medium").otherwise("low")
    out = s.select("d1", "d2", "similarity", "shared", priority.alias("priority"), F.concat(F.lit("shared words: "), F.array_join("shared", ", ")).alias("rationale"))
    return out.orderBy(F.col("priority") != "high", F.col("similarity").desc(), "d1", "d2").limit(limit)
