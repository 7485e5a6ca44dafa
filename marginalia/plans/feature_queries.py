"""Note and pair features, checks of vaults and tables, schedules and services."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions.text import human_bytes
from marginalia.operators import checks, domains, events, features, links, pairs, search
from marginalia.operators import notes as N
from marginalia.plans.base import LINKS, MARKED, NOTES, ends, marked, notes, query, six, sparse, texts
from marginalia.plans.text_queries import FEATURES
from marginalia.session import keep, table


def _fields(spark, sf_dir):
    return marked(spark, sf_dir).withColumn("fields", M.frontmatter(F.col("content")))


@query("x5_named_links", r"SELECT page_id, len(regexp_extract_all(html, 'https?://[^\s)]+'))::BIGINT AS urls, len(regexp_extract_all(html, '\[[^\]]+\]\[([^\]]+)\]'))::BIGINT AS refs FROM pages")
def named_links(spark, sf_dir):
    found = links.named_links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found["url_links"]).cast("long").alias("urls"), F.size(found["reference_links"]).cast("long").alias("refs"))


@query("m38_structure", r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '^#+\s+.+$')) AS hs, list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z]*'))) AS ts, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
SELECT doc_id, len(hs)::BIGINT AS heading_count, coalesce(list_max(list_transform(hs, lambda x: length(regexp_extract(x, '^(#+)', 1)))), 0)::BIGINT AS max_heading_depth, len(ts)::BIGINT AS terms, CASE WHEN regexp_matches(lower(text), 'algorithm|function|class|method|implementation') THEN 'technical' WHEN regexp_matches(lower(text), 'concept|theory|principle|framework') THEN 'conceptual' WHEN regexp_matches(lower(text), 'project|task|goal|objective') THEN 'project' ELSE 'general' END AS kind, round(CASE WHEN w > 0 THEN len(ts)::DOUBLE / w ELSE 0 END, 6) AS concept_density FROM l""")
def structure(spark, sf_dir):
    s = features.structure(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s["heading_count"].cast("long").alias("heading_count"), s["max_heading_depth"].cast("long").alias("max_heading_depth"), F.size(s["terms"]).cast("long").alias("terms"), s["kind"].alias("kind"), six(s["concept_density"], "concept_density"))


@query("m39_semantic_summary")
def semantic_summary(spark, sf_dir):
    s = features.structure(F.col("content"))
    n = _fields(spark, sf_dir).withColumns({"body": M.body(F.col("content"))})
    s = features.structure(F.col("body"))
    n = n.withColumns({"kind": s["kind"], "topics": s["topics"], "concepts": features.key_concepts(F.col("body"), F.col("fields"))})
    return n.select("doc_id", features.semantic_summary(F.col("body"), F.col("fields"), F.col("kind"), F.col("topics"), F.col("concepts")).alias("summary"))


PAIRED = f"""WITH {FEATURES}, c2 AS (SELECT *, list_sum(p) / len(p) AS cx FROM co)"""


@query("m10_content_similarity", f"""{PAIRED}, q AS (SELECT a.doc_id AS a, b.doc_id AS b, list_filter([CASE WHEN abs(a.sentiment_score - b.sentiment_score) <= 2 THEN 1 - abs(a.sentiment_score - b.sentiment_score) / 2 END, CASE WHEN a.content_type = b.content_type THEN 1.0 ELSE 0.0 END, CASE WHEN abs(a.cx - b.cx) <= 1 THEN 1 - abs(a.cx - b.cx) END], lambda x: x IS NOT NULL) AS l FROM c2 a JOIN c2 b ON b.doc_id = a.doc_id + 20) SELECT a, b, round(list_sum(l) / len(l), 5) AS content_similarity FROM q""")
def content_similarity(spark, sf_dir):
    # Both sides of the join read the features of a text, which are made once.
    f = keep(N.content_features(texts(spark, sf_dir), "text").select("doc_id", "sentiment_score", "content_type", "complexity_score"), "content-features")
    a, b = (f.select(*[F.col(c).alias(f"{k}_{c}") for c in f.columns]) for k in "ab")
    both = a.join(b, F.col("b_doc_id") == F.col("a_doc_id") + 20)
    of = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    return both.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"), F.round(pairs.content_similarity(of("sentiment_score"), of("content_type"), of("complexity_score")), 5).alias("content_similarity"))


@query("m11_topic_similarity", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS topic_similarity, a.label = b.label AND a.label <> -1 AS same_topic FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def topic_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.col("label").alias("s")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("label").alias("t"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(pairs.topic_similarity(F.col("x"), F.col("y")), 5).alias("topic_similarity"), pairs.same_topic(F.col("s"), F.col("t")).alias("same_topic"))


@query("m13_missing_features", "SELECT 'community_id is null' AS finding WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL SELECT 'pagerank is missing'")
def missing_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("community_id")), "doc_id", "left")
    return spark.createDataFrame([(f,) for f in checks.missing_features(d, ["doc_id", "community_id", "pagerank"])], "finding string")


@query("m14_h19_fallbacks", "SELECT doc_id, coalesce(quality, -1)::BIGINT AS community_id, 50.0::DOUBLE AS readability_score FROM documents LEFT JOIN labels USING (doc_id)")
def fallbacks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("community_id")), "doc_id", "left")
    return pairs.with_fallbacks(d, ["community_id", "readability_score"])


@query("h9_coerced", "SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS event_type, coalesce(value, 0.0) AS value FROM events")
def coerced(spark, sf_dir):
    return pairs.coerced(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type", "value"], [])


@query("m18_snippets", "SELECT event_id, 'Found via: ' || concat_ws(', ', 'semantic similarity: ' || CASE WHEN -value / 10 > -2 THEN 'high' WHEN -value / 10 > -5 THEN 'medium' ELSE 'low' END, CASE WHEN event_type IN ('click', 'view') THEN event_type || ' match' END) AS snippet FROM events WHERE value IS NOT NULL")
def snippets(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", search.snippet(-F.col("value") / 10, F.lit(0.6), F.when(F.col("event_type").isin("click", "view"), F.col("event_type"))).alias("snippet"))


@query("m36_analysis_summary", f"{PAIRED} SELECT doc_id, CASE WHEN cx > 0.7 THEN 'high' WHEN cx > 0.4 THEN 'medium' ELSE 'low' END AS complexity_level, CASE WHEN readability_score > 70 THEN 'easy' WHEN readability_score > 50 THEN 'moderate' ELSE 'difficult' END AS readability_level, technical_density > 0.1 AS technical_content, CASE WHEN heading_count > 5 THEN 'high' WHEN heading_count > 2 THEN 'medium' ELSE 'low' END AS structure_richness, CASE WHEN vocabulary_richness > 0.7 THEN 'high' WHEN vocabulary_richness > 0.5 THEN 'medium' ELSE 'low' END AS vocabulary_level FROM c2")
def analysis_summary(spark, sf_dir):
    out = N.analysis_summary(N.content_features(texts(spark, sf_dir), "text"))
    return out.select("doc_id", "complexity_level", "readability_level", "technical_content", "structure_richness", "vocabulary_level")


@query("h1_connection_groups", f"WITH {LINKS}, o AS (SELECT id, count(src) AS c FROM deg LEFT JOIN dense ON src = id GROUP BY id) SELECT (c // 5)::BIGINT AS cluster, min(id) AS centroid, count(*) AS notes, 'group_' || (c // 5) AS keyword FROM o GROUP BY c // 5 HAVING count(*) >= 3")
def connection_groups(spark, sf_dir):
    e = sparse(spark, sf_dir)
    out = ends(e).join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outbound")), "id", "left").na.fill(0, ["outbound"])
    return N.connection_groups(out.withColumnRenamed("id", "path")).select(F.col("cluster").cast("long").alias("cluster"), "centroid", "notes", "keyword")


@query("h3_descriptions", "WITH c AS (SELECT r_name AS cluster, count(n_name) AS notes, list_sort(list(n_name)) AS k FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) SELECT cluster, CASE WHEN coalesce(len(k), 0) >= 2 THEN 'Notes about ' || array_to_string(list_slice(k, 1, least(3, len(k)) - 1), ', ') || ' and ' || k[least(3, len(k))] WHEN len(k) = 1 THEN 'Notes about ' || k[1] ELSE 'Cluster of ' || notes || ' related notes' END AS description FROM c")
def descriptions(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    c = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("cluster")).agg(F.count("n_name").alias("notes"), F.array_sort(F.collect_list("n_name")).alias("k"))
    return c.select("cluster", N.description(F.col("notes"), F.col("k")).alias("description"))


@query("h4_para_exceptions", f"WITH {NOTES} SELECT path FROM (SELECT path FROM notes ORDER BY path LIMIT 10) WHERE NOT regexp_matches(lower(path), 'projects|areas|resources|archive|inbox') ORDER BY path LIMIT 5")
def para_exceptions(spark, sf_dir):
    return N.para_exceptions(notes(spark, sf_dir))


@query("h7_context_summary", f"WITH {NOTES} SELECT count(*) AS notes, (SELECT sum(size)::BIGINT FROM (SELECT size FROM notes ORDER BY path LIMIT 100)) AS size, 0.766667 AS confidence FROM notes")
def context_summary(spark, sf_dir):
    return N.context_summary(notes(spark, sf_dir), 2, True, False).select("notes", "size", six(F.col("confidence"), "confidence"))


@query("o8_recommendations")
def recommendations(spark, sf_dir):
    n = notes(spark, sf_dir)
    gaps = N.quality_gaps(N.assess(n.select("path", "content", "modified", "vault_name"), "2024-02-01"))
    return spark.createDataFrame([(r["title"], r["priority"]) for r in N.recommendations(N.organisation(n.select("path")).first()["confidence"], gaps)], "title string, priority string")


@query("u6_sampled", f"WITH {NOTES} SELECT path FROM notes ORDER BY md5('42|' || path), path LIMIT 100")
def sampled(spark, sf_dir):
    return N.sampled(notes(spark, sf_dir).select("path"), 100)


@query("v1_vault_check", f"WITH {NOTES} SELECT count(*) > 0 AS valid, count(*) AS notes FROM notes")
def vault_check(spark, sf_dir):
    r = checks.vault(notes(spark, sf_dir))
    return spark.createDataFrame([(r["valid"], r["notes"])], "valid boolean, notes long")


AREAS = f"WITH {NOTES}, f AS (SELECT vault_name AS folder, count(*) AS n, sum(size) AS size, count(DISTINCT lang) AS subs FROM notes GROUP BY 1)"


@query("v2_h17_areas", f"{AREAS} SELECT max((folder = 'src0')::INT) = 1 AS exists, coalesce(sum(n) FILTER (folder = 'src0'), 0)::BIGINT AS notes, coalesce(max(subs) FILTER (folder = 'src0'), 0)::BIGINT AS subfolders, coalesce(sum(size) FILTER (folder = 'src0'), 0)::BIGINT AS size, array_to_string(list_sort(list(folder) FILTER (folder <> 'src0')), ',') AS excluded, coalesce(sum(n) FILTER (folder = 'src0'), 0) >= 5 AS valid FROM f")
def areas(spark, sf_dir):
    return checks.areas(notes(spark, sf_dir), "src0").select("exists", "notes", "subfolders", "size", F.array_join("excluded", ",").alias("excluded"), "valid")


@query("v10_privacy", f"{AREAS} SELECT (sum(n) - coalesce(sum(n) FILTER (folder = 'src0'), 0))::BIGINT AS excluded_notes, round(100.0::DOUBLE * (sum(n) - coalesce(sum(n) FILTER (folder = 'src0'), 0)) / sum(n), 6) AS privacy_percentage FROM f")
def privacy(spark, sf_dir):
    return checks.areas(notes(spark, sf_dir), "src0").select("excluded_notes", six(F.col("privacy_percentage"), "privacy_percentage"))


@query("v8_content_sample", rf"""WITH {MARKED}, s AS (SELECT content, length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 50 AS solid FROM marked ORDER BY path LIMIT 20) SELECT count(*) AS sampled, avg(solid::INT) AS content_ratio, avg((contains(content, '[[') OR contains(content, ']('))::INT) AS link_ratio, avg(regexp_matches(content, '(?s)^---\s*\n.*?\n---\s*\n')::INT) AS metadata_ratio, round(avg(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))) FILTER (solid), 6) AS avg_words FROM s""")
def content_sample(spark, sf_dir):
    return checks.content_sample(marked(spark, sf_dir)).select("sampled", "content_ratio", "link_ratio", "metadata_ratio", six(F.col("avg_words"), "avg_words"))


@query("v6_describe", "SELECT 'o_totalprice' AS column, count(o_totalprice) AS n, 0::BIGINT AS nulls, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey), 0, round(avg(o_custkey), 4), round(stddev(o_custkey), 4), min(o_custkey), max(o_custkey) FROM orders")
def describe(spark, sf_dir):
    out = checks.describe(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
    return out.select("column", "n", "nulls", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "low", "high")


@query("v6_value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts(spark, sf_dir):
    return checks.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("t17_enumerated_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def enumerated(spark, sf_dir):
    return pairs.enumerated(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query("f19_discovered", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND list_has_all(['n' || s_nationkey % 3, 'any'], ['n1'])")
def discovered(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, "healthy").otherwise("unhealthy").alias("status"), F.array(F.concat(F.lit("n"), F.col("s_nationkey") % 3), F.lit("any")).alias("tags"))
    return events.discovered(s, ["n1"]).select("s_suppkey")


@query("r10_heartbeats", "SELECT user_id AS service, floor(epoch(max(ts)))::BIGINT AS last, CASE WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(max(ts)) > 86400 THEN 'unhealthy' ELSE 'healthy' END AS status FROM events GROUP BY user_id")
def heartbeats(spark, sf_dir):
    out = events.heartbeats(table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), "ts"), "2024-01-30 12:00:00", 86400)
    return out.select("service", F.col("last").cast("timestamp").cast("long").alias("last"), "status")


@query("o11_pending_tasks", "SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def pending(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return events.pending(o, 50).select("task_id")


@query("a19b_vault_counts", "SELECT event_type, user_id % 5 AS vault, count(*) AS n FROM events GROUP BY ALL")
def vault_counts(spark, sf_dir):
    return events.vault_counts(table(spark, sf_dir, "events").withColumn("vault", F.col("user_id") % 5))


@query("h18_error_summary", "SELECT event_type AS severity, user_id % 3 AS component, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1, 2")
def error_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("severity"), (F.col("user_id") % 3).alias("component"))
    return events.error_summary(e).select("severity", "component", "n", six(F.col("share"), "share"))


@query("h26_event_json", "SELECT event_id, event_type, value FROM events")
def event_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return events.from_json(events.as_json(e), "event_id long, event_type string, value double")


@query("m49_scheduled", "SELECT event_id FROM events WHERE extract('minute' FROM ts) % 15 = 0 AND extract('hour' FROM ts) BETWEEN 9 AND 17 AND extract('isodow' FROM ts) IN (1, 3, 5)")
def scheduled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(events.scheduled(F.col("ts").cast("timestamp"), "*/15 9-17 * * 0,2,4")).select("event_id")


@query("j15_graph_augmented", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e FROM v ORDER BY vec_id LIMIT 1), t AS (SELECT v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 3), l AS (SELECT vec_id AS src, vec_id + 1 AS dst FROM v WHERE vec_id % 2 = 0) SELECT vec_id AS path, round(score, 5) AS score, dst FROM t LEFT JOIN l ON src = vec_id")
def graph_augmented(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), "embedding")
    e = v.select(F.col("path").alias("src"), F.when(F.col("path") % 2 == 0, "LINKS_TO").otherwise("HAS_TAG").alias("rel_type"), (F.col("path") + 1).alias("dst"))
    return search.graph_augmented(v, e, v.orderBy("path").first()["embedding"]).select("path", F.round("score", 5).alias("score"), "dst")


@query("x32_sizes", "SELECT o_orderkey, CASE WHEN o_custkey * 977 < 1024 THEN (o_custkey * 977)::VARCHAR || ' B' WHEN o_custkey * 977 < 1048576 THEN printf('%.1f', floor(o_custkey * 977 / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(o_custkey * 977 / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size FROM orders")
def sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", human_bytes(F.col("o_custkey") * 977).alias("size"))


@query("t9_domain_clusters")
def domain_clusters(spark, sf_dir):
    return domains.domain_clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
