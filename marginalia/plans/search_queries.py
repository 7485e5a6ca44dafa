"""Scans, filters, keyword, vector and hybrid search over notes and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import vectors as V
from marginalia.operators import events, search, terms
from marginalia.plans.base import AS_OF, NOTES, notes, query, six, texts
from marginalia.plans.text_queries import WEIGHTS
from marginalia.session import table
from marginalia.sources import store, vault


def vectors_(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("label").cast("string").alias("vault_name"), "embedding")


def first_vector(spark, sf_dir):
    """The query: the vector of vec_id 0, one row."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


L2 = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label::VARCHAR AS vault_name, -sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM embeddings, q)"
COS = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label::VARCHAR AS vault_name, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)"


@query("j1_semantic_search", f"{L2} SELECT vec_id, vault_name, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def semantic_search(spark, sf_dir):
    hits = search.semantic(vectors_(spark, sf_dir), first_vector(spark, sf_dir), 10, key="vec_id")
    return hits.select("vec_id", "vault_name", six(F.col("score"), "score"))


@query("m1_cosine_top", f"{COS} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 25")
def cosine_top(spark, sf_dir):
    return search.semantic(vectors_(spark, sf_dir), first_vector(spark, sf_dir), 25, metric="cosine", key="vec_id").select("vec_id", six(F.col("score"), "score"))


@query("f8_vault_search", f"{L2} SELECT vec_id, round(score, 6) AS score FROM s WHERE vault_name = '3' ORDER BY score DESC, vec_id LIMIT 10")
def vault_search(spark, sf_dir):
    return search.semantic(vectors_(spark, sf_dir), first_vector(spark, sf_dir), 10, vault="3", key="vec_id").select("vec_id", six(F.col("score"), "score"))


@query("f7_threshold_after_top_k", f"{L2}, t AS (SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20) SELECT vec_id, round(score, 6) AS score FROM t WHERE score >= -1.2")
def threshold(spark, sf_dir):
    return search.semantic(vectors_(spark, sf_dir), first_vector(spark, sf_dir), 20, threshold=-1.2, key="vec_id").select("vec_id", six(F.col("score"), "score"))


@query("j1b_similar_without_self", f"{L2} SELECT vec_id, round(score, 6) AS score FROM s WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def similar(spark, sf_dir):
    q = first_vector(spark, sf_dir)
    return search.semantic(vectors_(spark, sf_dir).where("vec_id <> 0"), q, 10, key="vec_id").select("vec_id", six(F.col("score"), "score"))


@query("j1c_top_k_per_vault", f"{L2} SELECT vault_name, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vault_name ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def per_vault(spark, sf_dir):
    out = search.per_group(vectors_(spark, sf_dir), first_vector(spark, sf_dir), "vault_name", 5, key="vec_id")
    return out.select("vault_name", F.col("rank").cast("long").alias("rank"), "vec_id", six(F.col("score"), "score"))


@query("j1d_threshold_before_limit", f"{COS} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 5")
def threshold_first(spark, sf_dir):
    out = search.vector_scores(vectors_(spark, sf_dir), first_vector(spark, sf_dir), "cosine").where("score >= 0.2")
    return out.orderBy(F.col("score").desc(), "vec_id").limit(5).select("vec_id", six(F.col("score"), "score"))


@query("j2_similar_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2")
def similar_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.similar_pairs(v, 0.2).select("a", "b", six(F.col("similarity"), "similarity"))


@query("j16_hybrid_tag_filter", f"{COS} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1 AND vault_name IN ('1', '4') ORDER BY score DESC, vec_id LIMIT 10")
def tag_filter(spark, sf_dir):
    v = vectors_(spark, sf_dir).withColumn("tags", F.array("vault_name")).where(F.arrays_overlap("tags", F.array(F.lit("1"), F.lit("4"))))
    out = search.vector_scores(v, first_vector(spark, sf_dir), "cosine").where("score >= 0.1")
    return out.orderBy(F.col("score").desc(), "vec_id").limit(10).select("vec_id", six(F.col("score"), "score"))


@query("m3_centroids", "WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) SELECT label::BIGINT AS label, (p - 1)::BIGINT AS pos, round(avg(x), 6) AS mean FROM u GROUP BY label, p")
def centroids(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "x"))
    return v.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(six(F.avg(F.col("x").cast("double")), "mean"))


@query("m3_coherence", "WITH p AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label::BIGINT AS label, round(avg(c), 6) AS coherence FROM p GROUP BY label")
def coherence(spark, sf_dir):
    from marginalia.operators.domains import centroids as of

    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cluster"), "embedding")
    return of(v).select(F.col("cluster").alias("label"), six(F.col("coherence"), "coherence"))


@query("sc4_vault_structure", f"WITH {NOTES}, t AS (SELECT DISTINCT string_split(path, '/')[1] AS path, 'directory' AS type, 1 AS depth FROM notes UNION SELECT DISTINCT folder, 'directory', 2 FROM notes) SELECT path, type, depth::BIGINT AS depth FROM t")
def structure(spark, sf_dir):
    return vault.structure(notes(spark, sf_dir), 2).select("path", "type", F.col("depth").cast("long").alias("depth"))


@query("sc5_file_info", f"WITH {NOTES} SELECT path, size, checksum FROM notes WHERE path = 'src1/en/doc_1.md'")
def file_info(spark, sf_dir):
    return vault.file_info(notes(spark, sf_dir), "src1/en/doc_1.md").select("path", "size", "checksum")


@query("sc10_upsert", f"WITH {NOTES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE checksum END AS checksum FROM notes WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def upsert(spark, sf_dir):
    n = notes(spark, sf_dir).select("vault_name", "path", "checksum", "doc_id")
    return store.upserted(n.where("doc_id % 2 = 0"), n.where("doc_id % 3 = 0").withColumn("checksum", F.lit("new"))).select("path", "checksum")


@query("sc11_delete", f"WITH {NOTES} SELECT path FROM notes WHERE doc_id % 7 <> 0")
def delete(spark, sf_dir):
    n = notes(spark, sf_dir).select("vault_name", "path", "doc_id")
    return store.deleted(n, n.where("doc_id % 7 = 0")).select("path")


@query("f1_excluded_paths", f"WITH {NOTES} SELECT path FROM notes WHERE NOT (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/'))")
def excluded(spark, sf_dir):
    return notes(spark, sf_dir).where(~vault.within(F.col("path"), ["src1", "src2/en"])).select("path")


@query("f2_areas", f"WITH {NOTES} SELECT path FROM notes WHERE starts_with(path, 'src3/') OR starts_with(path, 'src4/fr/')")
def areas(spark, sf_dir):
    return notes(spark, sf_dir).where(vault.within(F.col("path"), ["src3", "src4/fr"])).select("path")


@query("f4_keyword_search", f"""WITH {NOTES}, m AS (SELECT path, content, CASE WHEN contains('doc_' || doc_id || '.md', 'ting') THEN 'name' WHEN contains(lower(content), 'ting') THEN 'content' END AS match_type, instr(lower(content), 'ting') AS pos FROM notes)
SELECT path, match_type, CASE WHEN match_type = 'content' THEN substr(content, greatest(1, pos - 40)::BIGINT, (pos + 44 - greatest(1, pos - 40))::BIGINT) END AS preview FROM m WHERE match_type IS NOT NULL ORDER BY path LIMIT 50""")
def keyword(spark, sf_dir):
    return vault.keyword_search(notes(spark, sf_dir), "ting", True, 50)


@query("f5_folder_search", f"WITH {NOTES}, e AS (SELECT folder, contains(path, 'doc_1') AS hit FROM notes UNION ALL SELECT vault_name, contains(path, 'doc_1') FROM notes) SELECT folder AS path, CASE WHEN contains(regexp_extract(folder, '([^/]*)$', 1), 'doc_1') THEN 'name' ELSE 'children' END AS match_type, sum(hit::BIGINT)::BIGINT AS hits FROM e GROUP BY folder HAVING sum(hit::BIGINT) > 0")
def folder_search(spark, sf_dir):
    return vault.folder_search(notes(spark, sf_dir), "doc_1")


@query("f6_recent_files", f"WITH {NOTES} SELECT path FROM notes WHERE modified > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY modified DESC, path LIMIT 50")
def recent(spark, sf_dir):
    return vault.recent(notes(spark, sf_dir), AS_OF, 30, 50).select("path")


@query("f9_point_lookup", f"WITH {NOTES} SELECT doc_id, vault_name FROM notes WHERE vault_name = 'src5' AND path = 'src5/en/doc_5.md'")
def lookup(spark, sf_dir):
    return notes(spark, sf_dir).where("vault_name = 'src5' and path = 'src5/en/doc_5.md'").select("doc_id", "vault_name")


@query("f11_changed_files", f"WITH {NOTES} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 5 = 1 THEN 'modified' ELSE 'checksum' END AS reason FROM notes WHERE doc_id % 5 IN (0, 1, 2)")
def changed(spark, sf_dir):
    n = notes(spark, sf_dir)
    stored = n.where("doc_id % 5 <> 0").withColumn("modified", F.when(F.expr("doc_id % 5 = 1"), F.expr("modified - interval 1 day")).otherwise(F.col("modified"))).withColumn("checksum", F.when(F.expr("doc_id % 5 = 2"), "old").otherwise(F.col("checksum")))
    return vault.changed(n, stored).select("path", "reason")


@query("f16_valid_content", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')")
def valid_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id")


@query("a1_note_count", "SELECT count(*) AS notes FROM documents")
def note_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("notes"))


@query("a3_vault_stats", f"WITH {NOTES} SELECT vault_name, count(*) AS notes, strftime(max(modified), '%Y-%m-%d') AS newest, strftime(min(modified), '%Y-%m-%d') AS oldest FROM notes GROUP BY vault_name")
def vault_stats(spark, sf_dir):
    s = store.vault_stats(notes(spark, sf_dir))
    return s.select("vault_name", "notes", F.date_format("newest", "yyyy-MM-dd").alias("newest"), F.date_format("oldest", "yyyy-MM-dd").alias("oldest"))


@query("a4_embedding_coverage", "SELECT count(*) AS vectors, count(embedding) AS embedded, count(DISTINCT label) AS labels FROM embeddings")
def coverage(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.count("embedding").alias("embedded"), F.count_distinct("label").alias("labels"))


#: Semantic scores of notes for fusion: minus a distance that the id decides.
HITS = f"""{NOTES}, sem AS (SELECT path, -((doc_id * 37 % 101) / 20.0)::DOUBLE AS score FROM notes WHERE doc_id % 4 = 0), kw AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'name' ELSE 'content' END AS match_type FROM notes WHERE doc_id % 6 = 0)"""


def _hits(spark, sf_dir):
    n = notes(spark, sf_dir)
    sem = n.where("doc_id % 4 = 0").select("path", F.expr("cast(-((doc_id * 37 % 101) / 20.0D) as double)").alias("score"))
    kw = n.where("doc_id % 6 = 0").select("path", F.when(F.expr("doc_id % 5 = 0"), "name").otherwise("content").alias("match_type"))
    return sem, kw


FUSED = f"""{HITS}, s AS (SELECT path, CASE WHEN score >= 0 THEN greatest(0.0, 1 - score) ELSE exp(score / 5) END AS a FROM sem),
k AS (SELECT path, least(1.0, CASE match_type WHEN 'name' THEN 0.7 ELSE 0.6 END + CASE WHEN contains(regexp_extract(path, '([^/]*)[.]md$', 1), 'doc_1') THEN 0.1 ELSE 0 END + CASE WHEN contains(path, 'doc_1') THEN 0.2 ELSE 0 END)::DOUBLE AS b FROM kw),
u AS (SELECT path, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.6 * a + 0.4 * b WHEN a IS NOT NULL THEN 0.9 * a ELSE 0.8 * b END AS c FROM s FULL JOIN k USING (path))"""


@query("m17_fused_scores", f"WITH {FUSED} SELECT path, round(a, 6) AS semantic_score, round(b, 6) AS keyword_score, round(c, 6) AS unified_score FROM u")
def fused(spark, sf_dir):
    out = search.fused(*_hits(spark, sf_dir), "doc_1")
    return out.select("path", *[six(F.col(c), c) for c in ("semantic_score", "keyword_score", "unified_score")])


@query("w1_diversified", f"WITH {FUSED}, r AS (SELECT *, regexp_extract(path, '^(.*)/', 1) AS folder, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY round(c, 9) DESC, path) AS rn FROM u) SELECT path, round(c, 6) AS unified_score FROM r WHERE rn <= 3 OR round(c, 9) > 0.8")
def diversified(spark, sf_dir):
    out = search.fused(*_hits(spark, sf_dir), "doc_1").withColumn("unified_score", F.round("unified_score", 9))
    return search.diversified(out, vault.folder("path")).select("path", six(F.col("unified_score"), "unified_score"))


@query("w5_o1_merged", f"WITH {HITS}, b AS (SELECT path, 'semantic' AS match, score FROM sem UNION ALL SELECT path, 'keyword', NULL FROM kw WHERE path NOT IN (SELECT path FROM sem)) SELECT path, match, round(score, 6) AS score FROM b ORDER BY match DESC, score DESC NULLS LAST, path LIMIT 400")
def merged(spark, sf_dir):
    return search.merged(*_hits(spark, sf_dir), 400).select("path", "match", six(F.col("score"), "score"))


@query("m19_freshness", f"WITH {NOTES}, a AS (SELECT path, date_diff('day', modified, TIMESTAMP '{AS_OF}') AS d FROM notes) SELECT path, (CASE WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.8 WHEN d <= 90 THEN 0.6 WHEN d <= 365 THEN 0.4 WHEN d <= 730 THEN 0.2 ELSE 0.1 END)::DOUBLE AS freshness FROM a")
def freshness(spark, sf_dir):
    age = (F.lit(AS_OF).cast("timestamp").cast("double") - F.col("modified").cast("double")) / 86400.0
    return notes(spark, sf_dir).select("path", S.freshness(age).alias("freshness"))


@query("m9_combined_similarity", f"WITH {WEIGHTS}, p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1), ti AS (SELECT p.a, p.b, coalesce(sum(i.weight * j.weight), 0) AS s FROM p LEFT JOIN w i ON i.id = p.a LEFT JOIN w j ON j.id = p.b AND j.term = i.term GROUP BY p.a, p.b) SELECT a, round(greatest(0.0, least(1.0, 0.7 * (c + 1) / 2 + 0.3 * s)), 6) AS combined FROM p JOIN ti USING (a, b)")
def combined(spark, sf_dir):
    """Vectors and texts of the same number are one note's."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = v.select(F.col("vec_id").alias("a"), "embedding").join(v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("other")), "a")
    d = texts(spark, sf_dir)
    found = terms.documents(d, "doc_id")
    alike = terms.pair_cosine(terms.weights(found, terms.vocabulary(found, d.count())), p.select("a", "b"))
    return p.join(alike, ["a", "b"]).select("a", six(S.combined_similarity(V.cosine(F.col("embedding"), F.col("other")), F.col("tfidf_similarity")), "combined"))


@query("w7_last_per_key", "SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def last_per_key(spark, sf_dir):
    return events.last_per_key(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"])


@query("w4_rate_window", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM events")
def rate(spark, sf_dir):
    return events.rate_window(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"]).select("event_id", six(F.col("rate"), "rate"))
