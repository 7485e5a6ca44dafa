"""Queries over notes with links and front matter of many forms, parsed on both sides from the same text."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.operators import features, links, overlap
from marginalia.operators import notes as N
from marginalia.plans.base import NOTES, notes, query, six, texts
from marginalia.session import keep

# The text of a note in words that both dialects know, from the document's length, number and language.
K1, K2 = "((length(content) * 7 + doc_id) % 150)", "((length(content) + doc_id * 3) % 150)"
FRONT = f"""CASE length(content) % 4 WHEN 0 THEN ''
  WHEN 1 THEN concat('---', chr(10), 'tags: [', lang, ', 🌱]', chr(10), 'aliases: a', length(content) % 50, ', b', chr(10), 'up: hub', length(content) % 7, chr(10), '---', chr(10))
  WHEN 2 THEN concat('---', chr(10), 'tags: ', lang, chr(10), 'similar: [x', length(content) % 3, ', y, z]', chr(10), 'leads_to: doc_', {K1}, chr(10), 'summary: About ', source, chr(10), '---', chr(10))
  ELSE concat('---', chr(10), 'category: ', source, chr(10), 'aliases: [one, two', length(content) % 9, ', three]', chr(10), 'domains: [d', length(content) % 4, ']', chr(10), 'status: 🌿', chr(10), '---', chr(10)) END"""
TAIL = f"""CASE length(content) % 5 WHEN 0 THEN concat('See [[doc_', {K1}, '|next]] and [page](https://x.org/a).')
  WHEN 1 THEN concat('![[doc_', {K1}, ']] and [[doc_', {K2}, '#Part ', length(content) % 3, '|alias]] #tag', length(content) % 4, ' end')
  WHEN 2 THEN concat('[rel](../', lang, '/doc_', {K1}, '.md) [[missing', length(content) % 9, ']]', chr(10), '> [!Note] Head ', length(content) % 6, chr(10), '> more')
  WHEN 3 THEN concat('plain ^block', length(content) % 6)
  ELSE concat('[[doc_', doc_id, ']] [[doc_', {K2}, ']] [[doc_', {K2}, '#^b1]] [x](doc_', {K1}, '.md)') END"""
CONTENT = f"concat({FRONT}, '# Title ', length(content), chr(10), chr(10), content, chr(10), chr(10), {TAIL}, chr(10))"


def linked(spark, sf_dir):
    """Notes with front matter of four forms and links of five; null texts count as empty."""
    n = notes(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    return n.withColumn("content", F.expr(CONTENT))


LINKED = f"""{NOTES}, filled AS (SELECT * REPLACE (coalesce(content, '') AS content) FROM notes), linked AS (SELECT * REPLACE ({CONTENT} AS content) FROM filled)"""
BODY = r"regexp_replace(content, '^(?s:---\s*\n.*?\n---\s*\n)', '')"
#: Lines of the front matter as key and value.
FIELDS = LINKED + r""", fm AS (SELECT doc_id, regexp_extract(content, '^(?s:---\s*\n(.*?)\n---\s*\n)', 1) AS f FROM linked), lines AS (SELECT doc_id, unnest(string_split(f, chr(10))) AS line FROM fm WHERE f <> ''),
kv AS (SELECT doc_id, split_part(line, ': ', 1) AS k, substr(line, length(split_part(line, ': ', 1)) + 3) AS v FROM lines),
lists AS (SELECT doc_id, k, v, CASE WHEN starts_with(v, '[') THEN string_split(trim(v, '[]'), ', ') ELSE string_split(v, ', ') END AS items FROM kv)"""


def _fields(spark, sf_dir):
    return linked(spark, sf_dir).withColumn("fields", M.frontmatter(F.col("content")))


@query("x1_frontmatter", f"""WITH {FIELDS}, t AS (SELECT doc_id, string_agg(k || '=' || CASE WHEN starts_with(v, '[') THEN '["' || array_to_string(items, '", "') || '"]' ELSE v END, ';' ORDER BY k) AS fields FROM lists GROUP BY doc_id) SELECT doc_id, coalesce(fields, '') AS fields, length({BODY}) AS body_length FROM linked LEFT JOIN t USING (doc_id)""")
def frontmatter(spark, sf_dir):
    entries = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _fields(spark, sf_dir).select("doc_id", F.array_join(entries, ";").alias("fields"), F.length(M.body(F.col("content"))).cast("long").alias("body_length"))


@query("x2_wikilink_parts", rf"""WITH {LINKED}, w AS (SELECT doc_id, unnest(regexp_extract_all({BODY}, '\[\[[^\]]*\]\]')) AS l FROM linked), p AS (SELECT doc_id, regexp_extract(l, '\[\[([^\]|]*)', 1) AS inner_, nullif(regexp_extract(l, '\|([^\]]*)\]', 1), '') AS alias FROM w)
SELECT doc_id, trim(regexp_extract(inner_, '^([^#^]*)', 1)) || '.md' AS target, alias, nullif(regexp_extract(inner_, '#([^^]*)', 1), '') AS section, nullif(regexp_extract(inner_, '\^(.*)$', 1), '') AS block_ref FROM p""")
def wikilink_parts(spark, sf_dir):
    return linked(spark, sf_dir).select("doc_id", F.explode(M.wikilinks(M.body(F.col("content")))).alias("l")).select("doc_id", "l.*")


@query("x3_wikilinks", rf"WITH {LINKED}, w AS (SELECT doc_id, unnest(regexp_extract_all(content, '\[\[[^\]]*\]\]')) AS l FROM linked) SELECT doc_id, regexp_extract(l, '\[\[([^\]|#^]*)', 1) || '.md' AS target, nullif(regexp_extract(l, '\|([^\]]*)\]', 1), '') AS alias FROM w")
def wikilinks(spark, sf_dir):
    return linked(spark, sf_dir).select("doc_id", F.explode(M.wikilinks(F.col("content"))).alias("l")).select("doc_id", "l.target", "l.alias")


@query("x31_outgoing", rf"WITH {LINKED} SELECT doc_id, unnest(regexp_extract_all(content, '\[\[([^\]|]+)', 1)) AS target FROM linked")
def outgoing(spark, sf_dir):
    return linked(spark, sf_dir).select("doc_id", F.explode(links.outgoing(F.col("content"))).alias("target"))


@query("x13_callouts", rf"""WITH {LINKED}, l AS (SELECT doc_id, string_split(content, chr(10)) AS ls FROM linked), n AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l)
SELECT doc_id, lower(regexp_extract(ls[k], '^\s*>\s*\[!([a-zA-Z]+)\]', 1)) AS type, trim(regexp_extract(ls[k], '^\s*>\s*\[![a-zA-Z]+\](.*)$', 1)) || chr(10) || 'more' AS content, k::BIGINT AS start_line, (k + 1)::BIGINT AS end_line FROM n WHERE regexp_matches(ls[k], '^\s*>\s*\[!([a-zA-Z]+)\]')""")
def callouts(spark, sf_dir):
    n = linked(spark, sf_dir).select("doc_id", F.explode(M.callouts(F.col("content"))).alias("c"))
    return n.select("doc_id", "c.type", "c.content", F.col("c.start_line").cast("long").alias("start_line"), F.col("c.end_line").cast("long").alias("end_line"))


@query("x14_blocks", rf"""WITH {LINKED}, l AS (SELECT doc_id, string_split(content, chr(10)) AS ls FROM linked), n AS (SELECT doc_id, trim(ls[k], ' ' || chr(9) || chr(13)) AS line, k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l))
SELECT doc_id, regexp_extract(line, '\^([a-zA-Z0-9_-]+)$', 1) AS id, k::BIGINT AS line_number, trim(regexp_replace(line, '\^([a-zA-Z0-9_-]+)$', '')) AS content FROM n WHERE regexp_matches(line, '\^([a-zA-Z0-9_-]+)$')""")
def blocks(spark, sf_dir):
    n = linked(spark, sf_dir).select("doc_id", F.explode(M.block_references(F.col("content"))).alias("b"))
    return n.select("doc_id", "b.id", F.col("b.line_number").cast("long").alias("line_number"), "b.content")


@query("x15_relationships", f"WITH {FIELDS} SELECT doc_id, k AS relation, unnest(list_transform(items, lambda x: x || '.md')) AS target FROM lists WHERE k IN ('up', 'similar', 'leads_to')")
def relationships(spark, sf_dir):
    n = _fields(spark, sf_dir).select("doc_id", F.explode(M.relationships(F.col("fields"))).alias("relation", "targets"))
    return n.select("doc_id", "relation", F.explode("targets").alias("target"))


#: Links once per source, raw target and type; then their targets: bare names by name in any case, paths from the folder.
EXTRACTED = LINKED + r""", raws AS (SELECT path AS source, 'wikilink' AS link_type, unnest(regexp_extract_all(content, '\[\[([^\]|]+)', 1)) AS raw FROM linked UNION ALL SELECT path, 'markdown_link', unnest(regexp_extract_all(content, '\[[^\]]*\]\(([^)\s]+)\)', 1)) FROM linked UNION ALL SELECT path, 'embedded_link', unnest(regexp_extract_all(content, '!\[\[([^\]|]+)', 1)) FROM linked),
ext AS (SELECT DISTINCT source, raw, link_type FROM raws WHERE NOT regexp_matches(raw, '^(https?|ftp|mailto):')),
md AS (SELECT *, CASE WHEN ends_with(p, '.md') THEN p ELSE p || '.md' END AS t FROM (SELECT *, regexp_replace(raw, '#.*$', '') AS p FROM ext)), named AS (SELECT lower(split_part(path, '/', -1)) AS name, min(path) AS found FROM linked GROUP BY 1),
tgt AS (SELECT source, raw, link_type, CASE WHEN contains(p, '/') THEN regexp_replace(regexp_extract(source, '^(.*)/', 1) || '/' || t, '[^/]+/\.\./', '') ELSE coalesce(found, t) END AS target FROM md LEFT JOIN named ON name = lower(t) AND NOT contains(p, '/')),
res AS (SELECT tgt.*, linked.path IS NOT NULL AS valid FROM tgt LEFT JOIN linked ON linked.path = target),
edg AS (SELECT DISTINCT source AS src, target AS dst FROM res WHERE valid AND source <> target)"""


def _resolved(spark, sf_dir):
    n = linked(spark, sf_dir)
    return links.resolved(links.extracted(n), n), n


@query("x8_extracted_links", f"WITH {EXTRACTED} SELECT source, raw, link_type FROM ext")
def extracted(spark, sf_dir):
    return links.extracted(linked(spark, sf_dir))


@query("x7_j4_resolved_links", f"WITH {EXTRACTED} SELECT source, raw, link_type, target, valid FROM res")
def resolved(spark, sf_dir):
    return _resolved(spark, sf_dir)[0]


@query("j5_g23_broken_links", f"WITH {EXTRACTED} SELECT source, target, count(*) AS links FROM res WHERE NOT valid GROUP BY source, target")
def broken(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].where("not valid").groupBy("source", "target").agg(F.count("*").alias("links"))


@query("g2_j7_link_graph", f"WITH {EXTRACTED} SELECT source AS src, target AS dst, max(link_type) AS link_type FROM res WHERE valid AND source <> target GROUP BY source, target")
def link_graph(spark, sf_dir):
    return links.edges(_resolved(spark, sf_dir)[0])


@query("a5_link_statistics", f"WITH {EXTRACTED}, per AS (SELECT linked.path, count(res.source) AS k FROM linked LEFT JOIN res ON res.source = linked.path GROUP BY linked.path) SELECT (SELECT count(*) FROM res) AS links, (SELECT count(DISTINCT target) FROM res) AS targets, (SELECT count(*) FROM res WHERE NOT valid) AS broken, (SELECT count(*) FROM res WHERE source = target) AS self_links, max(k) AS max_outgoing, round(avg(k), 6) AS avg_outgoing, sum((k = 0)::INT)::BIGINT AS notes_without_links, (SELECT count(*) // 2 FROM edg x JOIN edg y ON x.src = y.dst AND x.dst = y.src) AS both_ways FROM per")
def link_statistics(spark, sf_dir):
    out = links.statistics(*_resolved(spark, sf_dir))
    return out.withColumn("avg_outgoing", six(F.col("avg_outgoing"), "avg_outgoing"))


@query("a5_v7_links_by_type", f"WITH {EXTRACTED} SELECT link_type, count(*) AS links, sum((NOT valid)::INT)::BIGINT AS broken, avg((NOT valid)::INT) <= 0.5 AS acceptable FROM res GROUP BY link_type")
def links_by_type(spark, sf_dir):
    r = _resolved(spark, sf_dir)[0]
    bad = r.groupBy("link_type").agg(F.sum((~F.col("valid")).cast("long")).alias("broken"), (F.avg((~F.col("valid")).cast("int")) <= 0.5).alias("acceptable"))
    return links.by_type(r).join(bad, "link_type")


COUNTED = "SELECT doc_id, max(len(items)) FILTER (k = '{}') AS n FROM lists GROUP BY doc_id"


@query("m40_frontmatter_features", f"""WITH {FIELDS}, a AS ({COUNTED.format('aliases')}), d AS ({COUNTED.format('domains')}), s AS (SELECT doc_id, bool_or(k = 'summary' AND v <> '') AS told, bool_or(k = 'tags' AND list_contains(items, '🌱')) AS seed, bool_or(k = 'status' AND v = '🌿') AS plant FROM lists GROUP BY doc_id)
SELECT doc_id, coalesce(a.n, 0)::BIGINT AS aliases_count, coalesce(d.n, 0)::BIGINT AS domains_count, coalesce(told, false) AS has_summary_field, CASE WHEN seed THEN '🌱' WHEN plant THEN '🌿' ELSE 'unknown' END AS progress_state, CASE WHEN seed THEN 'seedling' WHEN plant THEN 'developing' ELSE 'unknown' END AS quality_stage FROM linked LEFT JOIN a USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN s USING (doc_id)""")
def frontmatter_features(spark, sf_dir):
    n = _fields(spark, sf_dir)
    n = n.withColumn("signs", features.progress(M.tags(F.col("content"), F.col("fields")), F.col("fields")))
    f = features.frontmatter_features(F.col("fields"), F.col("signs"))
    return n.select("doc_id", f["aliases_count"].cast("long").alias("aliases_count"), f["domains_count"].cast("long").alias("domains_count"), f["has_summary_field"].alias("has_summary_field"), f["progress_state"].alias("progress_state"), features.quality_stage(F.col("fields"), F.col("signs")).alias("quality_stage"))


@query("m41_relationship_counts", f"WITH {FIELDS}, c AS (SELECT doc_id, max(len(items)) FILTER (k = 'up') AS up, max(len(items)) FILTER (k = 'similar') AS alike, max(len(items)) FILTER (k = 'leads_to') AS leads_to FROM lists GROUP BY doc_id) SELECT doc_id, coalesce(up, 0)::BIGINT AS up, coalesce(alike, 0)::BIGINT AS alike, coalesce(leads_to, 0)::BIGINT AS leads_to FROM linked LEFT JOIN c USING (doc_id)")
def relationship_counts(spark, sf_dir):
    n = _fields(spark, sf_dir).withColumn("relationships", M.relationships(F.col("fields")))
    c = features.relationship_counts(F.col("relationships"))
    return n.select("doc_id", c["semantic_up_links"].cast("long").alias("up"), c["semantic_similar_links"].cast("long").alias("alike"), c["semantic_leads_to_links"].cast("long").alias("leads_to"))


@query("h8_flattened", f"WITH {FIELDS}, x AS (SELECT doc_id, max(len(items)::VARCHAR) FILTER (k = 'tags' AND starts_with(v, '[')) AS tags_count, max(array_to_string(items, ', ')) FILTER (k = 'tags' AND starts_with(v, '[')) AS tags_str, max(v) FILTER (k = 'aliases' AND NOT starts_with(v, '[')) AS aliases, max(v) FILTER (k = 'summary') AS summary FROM lists GROUP BY doc_id) SELECT doc_id, tags_count, tags_str, aliases, summary FROM linked LEFT JOIN x USING (doc_id)")
def flattened(spark, sf_dir):
    f = _fields(spark, sf_dir).select("doc_id", features.flattened(F.col("fields")).alias("f"))
    return f.select("doc_id", *[F.col("f")[k].alias(k) for k in ("tags_count", "tags_str", "aliases", "summary")])


@query("h6_related", rf"WITH {LINKED}, t AS (SELECT doc_id, list_transform(regexp_extract_all(content, '\[\[[^\]]+\]\]|\[[^\]]+\]\([^)]+\)'), lambda x: CASE WHEN starts_with(x, '[[') THEN x[3:-3] ELSE regexp_extract(x, '^\[([^\]]+)\]', 1) END) AS ts FROM linked) SELECT doc_id, array_to_string(list_slice(list_filter(ts, lambda x: NOT starts_with(x, 'http')), 1, 5), ',') AS related FROM t")
def related(spark, sf_dir):
    return linked(spark, sf_dir).select("doc_id", F.array_join(N.related(F.col("content")), ",").alias("related"))


@query("a25_distinct_tags", rf"WITH {FIELDS} SELECT unnest(items) AS value FROM lists WHERE k IN ('tags', 'category') UNION SELECT unnest(regexp_extract_all({BODY}, '(?:^|\s)#([a-zA-Z0-9_/-]+)(?:\s|$)', 1)) FROM linked")
def distinct_tags(spark, sf_dir):
    n = _fields(spark, sf_dir).select(M.tags(F.col("content"), F.col("fields")).alias("tags"))
    return links.distinct_values(n, "tags")


@query("j11_word_overlap", r"WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 3))) AS ws FROM documents), h AS (SELECT min(doc_id) AS id, ws FROM w WHERE len(ws) > 0 GROUP BY ws), e AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM h), p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i FROM e x JOIN e y ON x.word = y.word AND x.id < y.id GROUP BY x.id, y.id) SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS overlap FROM p WHERE i::DOUBLE / (na + nb - i) >= 0.5")
def word_overlap(spark, sf_dir):
    """Documents of different words, by their words longer than three letters: half of them shared."""
    d = texts(spark, sf_dir)
    sets, _ = overlap.word_sets(d, overlap.long_words(F.lower(F.col("text"))), "doc_id")
    return overlap.overlapping(keep(sets, "sets"), 0.5).select("a", "b", six(F.col("overlap"), "overlap"))


@query("f10_containing", f"WITH {NOTES} SELECT doc_id FROM notes WHERE contains(lower(content), 'data p') UNION ALL SELECT -doc_id FROM notes WHERE contains(path, 'en/doc_1')")
def containing(spark, sf_dir):
    """Notes by a part of their content and by a part of their path."""
    n = notes(spark, sf_dir)
    content, path = (keep(overlap.trigram_index(n, c, "doc_id").repartitionByRange("gram").sortWithinPartitions("gram"), f"grams-{c}") for c in ("content", "path"))
    found = overlap.containing(n, content, "content", "Data p", "doc_id").select("doc_id")
    return found.unionByName(overlap.containing(n, path, "path", "EN/doc_1", "doc_id").select((-F.col("doc_id")).alias("doc_id")))
