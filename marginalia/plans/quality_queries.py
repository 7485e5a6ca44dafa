"""Note quality, collection structure, events and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.operators import events as E
from marginalia.operators import notes as N
from marginalia.operators import pairs as P
from marginalia.plans.base import AS_OF, LINKS, NOTES, ends, notes, query, six, sparse
from marginalia.session import table
from marginalia.streaming import changes

METRICS = rf"""{NOTES}, h AS (SELECT path, content, date_diff('day', modified, TIMESTAMP '{AS_OF}') AS age, len(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+')) AS w, regexp_extract_all(content, '(?m)^(#{{1,6}})\s+.+', 1) AS hs,
  len(regexp_extract_all(content, '(?m)^\s*[-*+]\s+.+|^\s*\d+\.\s+.+')) AS li, len(regexp_extract_all(content, '\[\[([^\]]+)\]\]|\[([^\]]+)\]\([^)]+\)')) AS ln, len(regexp_extract_all(content, '#[a-zA-Z][a-zA-Z0-9_/-]*')) AS tg,
  len(regexp_extract_all(content, '(?s)```.*?```|`[^`]+`')) AS cd, len(regexp_extract_all(content, '- \[ \]|TODO:|FIXME:|NOTE:')) AS td, len(list_filter(string_split(content, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S'))) AS pa FROM notes),
m AS (SELECT *, len(hs) AS hd, len(list_distinct(list_transform(hs, lambda x: length(x)))) AS lv, greatest(1.0, w / 200.0) AS rd, w::DOUBLE / greatest(1, pa) AS pl FROM h)"""
SCORED = f"""{METRICS}, sc AS (SELECT *, least(1.0::DOUBLE, (CASE WHEN w >= 500 THEN 0.4 WHEN w >= 200 THEN 0.3 WHEN w >= 100 THEN 0.2 WHEN w >= 50 THEN 0.1 ELSE 0 END + CASE WHEN hd >= 3 THEN 0.15 WHEN hd >= 1 THEN 0.1 ELSE 0 END + CASE WHEN li >= 3 THEN 0.1 WHEN li >= 1 THEN 0.05 ELSE 0 END + CASE WHEN pa >= 3 THEN 0.05 ELSE 0 END
  + CASE WHEN pl >= 50 THEN 0.15 WHEN pl >= 25 THEN 0.1 WHEN pl >= 15 THEN 0.05 ELSE 0 END + CASE WHEN cd > 0 THEN 0.05 ELSE 0 END + CASE WHEN tg >= 2 THEN 0.05 ELSE 0 END + CASE WHEN rd >= 3 THEN 0.05 ELSE 0 END)::DOUBLE) AS completeness,
  least(1.0::DOUBLE, (CASE WHEN hd >= 5 THEN 0.4 WHEN hd >= 3 THEN 0.3 WHEN hd >= 1 THEN 0.2 ELSE 0 END + CASE WHEN lv >= 2 THEN 0.1 ELSE 0 END + CASE WHEN li >= 5 THEN 0.2 WHEN li >= 2 THEN 0.15 WHEN li >= 1 THEN 0.1 ELSE 0 END + CASE WHEN pa >= 3 THEN 0.1 ELSE 0 END
  + CASE WHEN pl BETWEEN 20 AND 100 THEN 0.1 WHEN pl BETWEEN 10 AND 150 THEN 0.05 ELSE 0 END + CASE WHEN tg >= 3 THEN 0.1 WHEN tg >= 1 THEN 0.05 ELSE 0 END + CASE WHEN td > 0 THEN 0.1 ELSE 0 END)::DOUBLE) AS structure,
  (CASE WHEN ln >= 10 THEN 0.4 WHEN ln >= 5 THEN 0.3 WHEN ln >= 2 THEN 0.2 WHEN ln >= 1 THEN 0.1 ELSE 0 END + least(0.1, ln / 50.0) * 0.1)::DOUBLE AS connections,
  (CASE WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.8 WHEN age <= 90 THEN 0.6 WHEN age <= 365 THEN 0.4 WHEN age <= 730 THEN 0.2 ELSE 0.1 END)::DOUBLE AS freshness FROM m),
ov AS (SELECT *, least(1.0, (0.4 * completeness + 0.3 * structure + 0.3 * connections + 0.2 * freshness) / 1.2) AS overall FROM sc)"""
#: Scores are cut to nine digits before they are compared with a band's edge.
LEVEL = "CASE WHEN round(overall, 9) <= 0.25 THEN 'seedling' WHEN round(overall, 9) <= 0.5 THEN 'growing' WHEN round(overall, 9) <= 0.75 THEN 'mature' ELSE 'comprehensive' END"


@query("m28_content_structure", f"WITH {METRICS} SELECT path, w::BIGINT AS words, hd::BIGINT AS headers, li::BIGINT AS lists, ln::BIGINT AS links, tg::BIGINT AS tags, cd::BIGINT AS code, td::BIGINT AS todos, pa::BIGINT AS paragraphs, round(pl, 6) AS paragraph_length FROM m")
def content_structure(spark, sf_dir):
    m = N.content_structure(F.col("content"))
    return notes(spark, sf_dir).select("path", *[m[k].cast("long").alias(k) for k in ("words", "headers", "lists", "links", "tags", "code", "todos", "paragraphs")], six(m["paragraph_length"], "paragraph_length"))


def assessed(spark, sf_dir):
    out = N.assess(notes(spark, sf_dir).select("path", "content", "modified", "vault_name"), AS_OF)
    return out.withColumn("level", S.quality_level(F.round("overall", 9)))


@query("m20_m24_quality_scores", f"WITH {SCORED} SELECT path, round(completeness, 6) AS completeness, round(structure, 6) AS structure, round(connections, 6) AS connections, freshness, round(overall, 6) AS overall, {LEVEL} AS level FROM ov")
def quality_scores(spark, sf_dir):
    return assessed(spark, sf_dir).select("path", *[six(F.col(c), c) for c in ("completeness", "structure", "connections")], "freshness", six(F.col("overall"), "overall"), "level")


@query("a7_quality_distribution", f"WITH {SCORED} SELECT {LEVEL} AS level, count(*) AS notes, round(avg(overall), 6) AS mean_score FROM ov GROUP BY 1")
def quality_distribution(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("level").agg(F.count("*").alias("notes"), six(F.avg("overall"), "mean_score"))


def _told(rows: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for cond, text in rows) + "], lambda x: x IS NOT NULL)"


#: The texts are those of the operator; the conditions are written out anew.
SUGGESTED = _told([
    ("completeness < 0.5 AND w < 100", N.SUGGESTIONS[0]), ("completeness < 0.5 AND hd = 0", N.SUGGESTIONS[1]), ("completeness < 0.5 AND pa < 3", N.SUGGESTIONS[2]),
    ("structure < 0.5 AND hd < 2", N.SUGGESTIONS[3]), ("structure < 0.5 AND li = 0", N.SUGGESTIONS[4]), ("structure < 0.5 AND tg = 0", N.SUGGESTIONS[5]),
    ("connections < 0.3 AND ln = 0", N.SUGGESTIONS[6]), ("connections < 0.3 AND ln BETWEEN 1 AND 2", N.SUGGESTIONS[7]), ("freshness < 0.4", N.SUGGESTIONS[9]), ("td > 0", N.SUGGESTIONS[10]),
])
FOUND = _told([("w < 50", N.ISSUES[0]), ("hd = 0", N.ISSUES[1]), ("ln = 0", N.ISSUES[2]), ("freshness < 0.3", N.ISSUES[4]), ("tg = 0", N.ISSUES[5])])
ADVICE = f"""{SCORED}, ad AS (SELECT path, overall, {SUGGESTED} AS sg, {FOUND} AS iss, greatest(0.1, least(1.0, 0.7 + CASE WHEN w >= 200 THEN 0.1 WHEN w < 50 THEN -0.2 ELSE 0 END - 0.1 + CASE WHEN w < 20 OR w > 5000 THEN -0.1 ELSE 0 END)) AS confidence,
  least(1.0, overall + CASE WHEN w < 200 THEN 0.2 ELSE 0 END + CASE WHEN hd < 2 THEN 0.1 ELSE 0 END + CASE WHEN ln < 3 THEN 0.15 ELSE 0 END + CASE WHEN tg = 0 THEN 0.05 ELSE 0 END) AS potential FROM ov),
ga AS (SELECT *, CASE WHEN list_contains(iss, 'Content too short') THEN 'completeness' WHEN list_contains(iss, 'Missing headers') OR list_contains(iss, 'No tags for categorization') THEN 'structure' WHEN list_contains(iss, 'No outbound links') THEN 'connections' WHEN list_contains(iss, 'Content is stale') THEN 'freshness' ELSE 'general' END AS gap_type,
  CASE WHEN overall < 0.2 THEN 'high' WHEN overall < 0.4 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN len(iss) >= 4 THEN '2h' WHEN len(iss) >= 2 THEN '30min' ELSE '10min' END AS effort FROM ad)"""


@query("m25_suggestions", f"WITH {ADVICE} SELECT path, array_to_string(list_slice(sg, 1, 5), '; ') AS suggestions, array_to_string(iss, '; ') AS issues, round(confidence::DOUBLE, 6) AS confidence, gap_type, priority, effort FROM ga")
def suggestions(spark, sf_dir):
    return assessed(spark, sf_dir).select("path", F.array_join("suggestions", "; ").alias("suggestions"), F.array_join("issues", "; ").alias("issues"), six(F.col("confidence"), "confidence"), "gap_type", "priority", "effort")


@query("o5_quality_gaps", f"WITH {ADVICE} SELECT path, priority, round((potential - overall)::DOUBLE, 6) AS improvement FROM ga WHERE len(iss) > 0 ORDER BY priority <> 'high', round(potential - overall, 9) DESC, path LIMIT 50")
def gaps(spark, sf_dir):
    return N.quality_gaps(assessed(spark, sf_dir)).select("path", "priority", six(F.col("improvement"), "improvement"))


@query("m26_domain", f"""WITH {NOTES} SELECT path, CASE {' '.join(f"WHEN regexp_matches(lower(path), '{'|'.join(k)}') THEN '{d}'" for d, k in S.DOMAINS.items())} {' '.join(f"WHEN regexp_matches(lower(content), '{'|'.join(k)}') THEN '{d}'" for d, k in S.DOMAIN_WORDS.items())} END AS domain FROM notes""")
def domain(spark, sf_dir):
    return notes(spark, sf_dir).select("path", S.domain(F.col("path"), F.col("content")).alias("domain"))


@query("m27_connection_metrics", f"WITH {LINKS}, n AS (SELECT id FROM deg), t AS (SELECT count(*) - 1 AS t FROM n), o AS (SELECT src AS id, count(*) AS c FROM dense GROUP BY src), i AS (SELECT dst AS id, count(*) AS c FROM dense GROUP BY dst) SELECT id, coalesce(o.c, 0) AS outbound, coalesce(i.c, 0) AS inbound, round((coalesce(o.c, 0) + coalesce(i.c, 0))::DOUBLE / greatest(1, t), 6) AS density, round(least(1.0, coalesce(o.c, 0) / greatest(1.0::DOUBLE, 0.1 * t)), 6) AS hub, round(least(1.0, coalesce(i.c, 0) / greatest(1.0::DOUBLE, 0.05 * t)), 6) AS authority FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id), t")
def connection_metrics(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return N.connection_metrics(ends(e), e).select("id", "outbound", "inbound", *[six(F.col(c), c) for c in ("density", "hub", "authority")])


@query("a8_depth_metrics", f"""WITH {NOTES}, d AS (SELECT len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, count(*) AS n FROM notes GROUP BY 1), a AS (SELECT max(depth) AS m, sum(depth * n)::DOUBLE / sum(n) AS av, count(*) AS v, sum(n) AS t FROM d),
e AS (SELECT m, av, v, CASE WHEN v > 1 THEN (SELECT -sum(n / t * log2(n / t)) FROM d, a) / log2(v) ELSE 0 END AS ev FROM a)
SELECT m::BIGINT AS max_depth, av AS avg_depth, v AS variety, round(ev::DOUBLE, 6) AS evenness, round(least(1.0, m / 10.0 * 0.4 + v / 8.0 * 0.3 + ev * 0.3)::DOUBLE, 6) AS complexity, round(greatest(0.0, least(1.0, 0.7 - CASE WHEN av < 1.5 THEN 0.2 WHEN av > 5 THEN 0.3 WHEN m > 8 THEN 0.2 ELSE 0 END + ev * 0.3))::DOUBLE, 6) AS organization FROM e""")
def depth_metrics(spark, sf_dir):
    out = N.depth_metrics(notes(spark, sf_dir).select("path"))
    return out.select(F.col("max_depth").cast("long").alias("max_depth"), "avg_depth", "variety", *[six(F.col(c), c) for c in ("evenness", "complexity", "organization")])


@query("a9_directory_clusters", f"""WITH {NOTES}, p AS (SELECT folder, count(*) AS files FROM notes GROUP BY folder HAVING count(*) >= 2), t AS (SELECT folder, unnest(regexp_split_to_array(lower(stem), '[-_\\s.]+')) AS word FROM notes JOIN p USING (folder) UNION ALL SELECT folder, unnest(regexp_split_to_array(lower(regexp_extract(folder, '[^/]*$')), '[-_\\s.]+')) FROM p),
k AS (SELECT folder, word, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, word) AS rn FROM t WHERE length(word) > 2 GROUP BY folder, word), g AS (SELECT folder, string_agg(word, ',' ORDER BY rn) AS keywords, count(*) AS n FROM k WHERE rn <= 5 GROUP BY folder)
SELECT folder, files, 3::BIGINT AS min_depth, 3::BIGINT AS max_depth, coalesce(keywords, '') AS keywords, round(least(1.0, coalesce(n, 0) / greatest(3.0, files * 0.5))::DOUBLE, 6) AS coherence FROM p LEFT JOIN g USING (folder) ORDER BY least(1.0, coalesce(n, 0) / greatest(3.0, files * 0.5)) DESC, folder LIMIT 20""")
def directory_clusters(spark, sf_dir):
    out = N.directory_clusters(notes(spark, sf_dir).select("path", "folder"))
    return out.select("folder", "files", F.col("min_depth").cast("long").alias("min_depth"), F.col("max_depth").cast("long").alias("max_depth"), F.array_join("keywords", ",").alias("keywords"), six(F.col("coherence"), "coherence"))


@query("a10_folder_hierarchy", f"WITH {NOTES}, f AS (SELECT DISTINCT vault_name AS folder, 1 AS d FROM notes UNION SELECT DISTINCT folder, 2 FROM notes) SELECT count(*) AS folders, max(d)::BIGINT AS max_depth, round(avg(d), 6) AS avg_depth, sum((d = 1)::INT)::BIGINT AS roots FROM f")
def folder_hierarchy(spark, sf_dir):
    return N.folder_hierarchy(notes(spark, sf_dir)).select("folders", F.col("max_depth").cast("long").alias("max_depth"), six(F.col("avg_depth"), "avg_depth"), "roots")


def _any(names: str, patterns: list[str]) -> str:
    return " + ".join(f"(SELECT coalesce(max(regexp_matches(name, '(?i){p}')::INT), 0) FROM {names})" for p in patterns)


ORGANISED = f"""WITH {NOTES}, fo AS (SELECT DISTINCT lower(name) AS name, folder FROM (SELECT vault_name AS folder, vault_name AS name FROM notes UNION SELECT folder, lang FROM notes)), fi AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM notes),
a AS (SELECT (SELECT avg((NOT regexp_matches(name, '^\\d+') AND NOT regexp_matches(name, '\\d{{4}}[-/]\\d{{1,2}}') AND NOT starts_with(name, '.') AND length(name) > 2)::INT) FROM fo) AS share, {_any('fo', N.PARA_FOLDERS)} AS para, {_any('fo', N.PARA_PATTERNS)} AS pp, {_any('fo', N.DECIMAL_PATTERNS)} AS dd, {_any('fi', N.DECIMAL_PATTERNS)} AS df,
  (SELECT ({' + '.join(f"sum(regexp_matches(name, '(?i){p}')::INT)" for p in N.ZETTEL_PATTERNS)})::DOUBLE / count(*) FROM fi) AS z, (SELECT ({' + '.join(f"sum(regexp_matches(path, '{p}')::INT)" for p in N.DATE_PATTERNS)})::DOUBLE / count(*) FROM fi) AS da),
s AS (SELECT least(1.0, CASE WHEN para >= 3 THEN 0.6 WHEN para >= 2 THEN 0.4 WHEN para >= 1 THEN 0.2 ELSE 0 END + least(0.4, 0.2 * pp))::DOUBLE AS s_para, least(1.0, CASE WHEN dd >= 2 THEN 0.7 WHEN dd >= 1 THEN 0.4 ELSE 0 END + least(0.3, 0.1 * df))::DOUBLE AS s_johnny_decimal,
  (CASE WHEN z > 0.5 THEN 0.8 WHEN z > 0.3 THEN 0.6 WHEN z > 0.1 THEN 0.3 WHEN z > 0 THEN 0.1 ELSE 0 END)::DOUBLE AS s_zettelkasten, (CASE WHEN share > 0.7 THEN 0.6 WHEN share > 0.5 THEN 0.4 WHEN share > 0.3 THEN 0.2 ELSE 0 END)::DOUBLE AS s_topic_based, (CASE WHEN da > 0.4 THEN 0.7 WHEN da > 0.2 THEN 0.4 WHEN da > 0.1 THEN 0.2 ELSE 0 END)::DOUBLE AS s_chronological FROM a),
t AS (SELECT *, greatest(s_para, s_johnny_decimal, s_zettelkasten, s_topic_based, s_chronological) AS best, (s_para > 0.3)::INT + (s_johnny_decimal > 0.3)::INT + (s_zettelkasten > 0.3)::INT + (s_topic_based > 0.3)::INT + (s_chronological > 0.3)::INT AS high FROM s)
SELECT * EXCLUDE (best, high), CASE WHEN high > 1 THEN 'mixed' WHEN best < 0.2 THEN 'unknown' WHEN s_para = best THEN 'para' WHEN s_johnny_decimal = best THEN 'johnny_decimal' WHEN s_zettelkasten = best THEN 'zettelkasten' WHEN s_topic_based = best THEN 'topic_based' ELSE 'chronological' END AS method, round(CASE WHEN high > 1 THEN greatest(0.4, best * 0.8) WHEN best < 0.2 THEN 0.1 ELSE best END, 6) AS confidence FROM t"""


@query("m45_organisation", ORGANISED)
def organisation(spark, sf_dir):
    out = N.organisation(notes(spark, sf_dir).select("path"))
    return out.select(*[six(F.col(c), c) for c in out.columns if c.startswith("s_")], "method", six(F.col("confidence"), "confidence"))


@query("a19_event_statistics", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, sum((value > 5.0)::INT)::BIGINT AS alerts FROM events GROUP BY event_type")
def event_statistics(spark, sf_dir):
    return E.statistics(table(spark, sf_dir, "events")).select("event_type", "n", F.round("total", 4).alias("total"), six(F.col("mean"), "mean"), "alerts")


@query("a20_metrics", "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, sum((event_type = 'error')::INT)::BIGINT AS errors, arg_max(value, (ts, event_id)) AS gauge FROM events WHERE starts_with(event_type, 'c') OR event_type = 'error' GROUP BY event_type")
def metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type like 'c%' or event_type = 'error'").select(F.col("event_type").alias("name"), "ts", F.col("event_id").alias("id"), "value", (F.col("event_type") == "error").alias("error"))
    return E.metrics(e).select("name", "n", six(F.col("mean"), "mean"), "errors", "gauge")


@query("f13_event_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND user_id % 3 = 0")
def event_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("priority", F.when(F.expr("user_id % 3 = 0"), 3).otherwise(1))
    return E.matching(e, types=["click", "error"], least_priority=2).select("event_id")


@query("f14_event_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10' AND event_type IN ('purchase') ORDER BY ts, event_id LIMIT 100")
def event_range(spark, sf_dir):
    return E.between(table(spark, sf_dir, "events"), "2024-01-05", "2024-01-10", ["purchase"], 100).select("event_id")


@query("r6_retained_events", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def retained(spark, sf_dir):
    return E.retained(table(spark, sf_dir, "events"), 500).select("event_id")


@query("m47_json_fields", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_fields(spark, sf_dir):
    return E.json_fields(table(spark, sf_dir, "events"), "props", ["page"]).select("event_id", "page")


@query("r7_windowed_counts", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    out = changes.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("long").alias("start"), "event_type", "n")


@query("j14_consistency", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS covered")
def consistency(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return l.join(d, "doc_id", "left_anti").agg(F.count("*").alias("missing")).join(F.broadcast(d.join(l, "doc_id", "left_semi").agg(F.count("*").alias("covered"))))  # one row each


@query("a7_label_distribution", "SELECT lang, quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_distribution(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"))


@query("m12_score_repair", "SELECT event_id, greatest(0.0, least(1.0, coalesce(value, 0.5) / 50 - 0.2)) AS score FROM events")
def score_repair(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.clamp(F.nanvl(F.coalesce("value", F.lit(0.5)), F.lit(0.5)) / 50 - 0.2).alias("score"))


@query("a21_type_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def type_distribution(spark, sf_dir):
    return E.type_distribution(table(spark, sf_dir, "events"))


@query("o10_turn_order", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def turn_order(spark, sf_dir):
    return E.turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query("a12_folder_words", f"""WITH {NOTES}, w AS (SELECT lang AS cluster, 0 AS part, unnest(regexp_split_to_array(lower(stem), '[^a-z]+')) AS word FROM notes UNION ALL SELECT lang, 1, unnest(regexp_split_to_array(lower(content), '[^a-z]+')) FROM notes),
r AS (SELECT cluster, part, word, row_number() OVER (PARTITION BY cluster, part ORDER BY count(*) DESC, word) AS rn FROM w WHERE length(word) > 2 GROUP BY cluster, part, word), b AS (SELECT cluster, word, min((part, rn)) AS pos FROM r WHERE (part = 0 AND rn <= 10) OR (part = 1 AND rn <= 5) GROUP BY cluster, word)
SELECT cluster, array_to_string(list_slice(list(word ORDER BY pos), 1, 8), ',') AS keywords FROM b GROUP BY cluster""")
def folder_words(spark, sf_dir):
    from marginalia.operators.domains import cluster_keywords

    return cluster_keywords(notes(spark, sf_dir).select(F.col("lang").alias("cluster"), "path", "content")).select("cluster", F.array_join("keywords", ",").alias("keywords"))


@query("v3_note_checks", "SELECT 'many nulls in quality' AS finding WHERE (SELECT sum((quality IS NULL)::INT) > 0.1 * count(*) FROM documents LEFT JOIN labels USING (doc_id)) UNION ALL SELECT 'negative words' WHERE (SELECT count(*) FROM documents) > 0 UNION ALL SELECT 'a single stage' WHERE (SELECT count(*) FROM documents) > 0")
def note_checks(spark, sf_dir):
    """A table with nulls, a negative count and one stage only, as the operator finds them."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = d.select(F.col("doc_id").cast("string").alias("path"), "quality", (F.when(F.col("doc_id") == 0, -1).otherwise(F.length("text"))).alias("words"), F.lit("unknown").alias("quality_stage"))
    return spark.createDataFrame([(f,) for f in P.check_notes(n, ["words"])], "finding string")


@query("m6_word_count_ratio", r"WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents) SELECT a.doc_id AS a, round(CASE WHEN greatest(a.n, b.n) > 0 THEN least(a.n, b.n)::DOUBLE / greatest(a.n, b.n) ELSE 0 END, 6) AS ratio FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def word_count_ratio(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))
    o = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"))
    return w.join(o, "doc_id").select(F.col("doc_id").alias("a"), six(S.word_count_ratio(F.col("n"), F.col("m")), "ratio"))
