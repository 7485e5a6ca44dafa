"""Text features, parsing and terms over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions import text as T
from marginalia.operators import notes as N
from marginalia.operators import topics
from marginalia.operators import terms
from marginalia.plans.base import MARKED, NOTES, marked, notes, query, six, texts
from marginalia.session import table
from marginalia.sources.vault import cache_key as cache_key_of
from marginalia.sources.vault import checksum as checksum_of
from marginalia.sources.vault import folder, stem


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


def matches(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


@query("x23_word_count", f"SELECT doc_id, {WORDS}::BIGINT AS word_count, length(text)::BIGINT AS character_count FROM documents")
def word_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.word_count(F.col("text")).cast("long").alias("word_count"), F.length("text").cast("long").alias("character_count"))


@query("x24_regex_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS words FROM documents")
def regex_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.regex_word_count(F.col("text")).cast("long").alias("words"))


@query("x25_checksum", "SELECT doc_id, md5(text) AS checksum FROM documents")
def checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checksum_of(F.col("text")).alias("checksum"))


@query("x26_cache_key", "SELECT doc_id, substr(sha256(text || '|10|' || source), 1, 16) AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cache_key_of(F.col("text"), F.lit("10"), F.col("source")).alias("cache_key"))


@query("x27_content_hash", f"WITH {NOTES}, r AS (SELECT vault_name, path || ':' || size AS item, row_number() OVER (PARTITION BY vault_name ORDER BY path) AS rn FROM notes) SELECT vault_name, substr(md5(string_agg(item, '|' ORDER BY item)), 1, 16) AS content_hash FROM r WHERE rn <= 100 GROUP BY vault_name")
def content_hash(spark, sf_dir):
    n = notes(spark, sf_dir).select("vault_name", F.concat_ws(":", "path", F.col("size").cast("string")).alias("item"), F.row_number().over(Window.partitionBy("vault_name").orderBy("path")).alias("rn")).where("rn <= 100")
    return n.groupBy("vault_name").agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("item")), "|")), 1, 16).alias("content_hash"))


@query("x28_path_parts", f"WITH {NOTES} SELECT doc_id, regexp_extract(path, '([^/]*)[.][^.]*$', 1) AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, len(string_split(path, '/'))::BIGINT AS depth FROM notes")
def path_parts(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", stem("path").alias("stem"), folder("path").alias("parent"), F.size(T.path_parts(F.col("path"))).cast("long").alias("depth"))


SENTIMENT = rf"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, (len(list_filter(ws, lambda w: list_contains({quoted(T.POSITIVE)}, w))) - len(list_filter(ws, lambda w: list_contains({quoted(T.NEGATIVE)}, w))))::DOUBLE / len(ws) * 10)) END AS score FROM w)"""


@query("m29_sentiment", f"WITH {SENTIMENT} SELECT doc_id, round(score, 6) AS score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM s")
def sentiment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentiment(F.col("text")).alias("s"))
    return d.select("doc_id", six(F.col("s"), "score"), T.sentiment_label(F.col("s")).alias("label"))


READABILITY = rf"""r0 AS (SELECT doc_id, {WORDS} AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS s, length(regexp_replace(text, '\s+', '', 'g')) AS c FROM documents),
r AS (SELECT doc_id, w, CASE WHEN s > 0 THEN w::DOUBLE / s ELSE 0 END AS asl, CASE WHEN w > 0 THEN c::DOUBLE / w ELSE 0 END AS awl FROM r0),
f AS (SELECT doc_id, w, asl, awl, CASE WHEN asl > 0 THEN greatest(0.0, 206.835 - 1.015 * asl - 84.6 * (awl / 4.7)) ELSE 0.0 END AS flesch, CASE WHEN asl > 0 THEN greatest(0.0, 0.39 * asl + 11.8 * (awl / 4.7) - 15.59) ELSE 0.0 END AS grade FROM r)"""


@query("m30_readability", f"WITH {READABILITY} SELECT doc_id, round(asl, 6) AS avg_sentence_length, round(awl, 6) AS avg_word_length, round(flesch::DOUBLE, 6) AS flesch, round(grade::DOUBLE, 6) AS grade FROM f")
def readability(spark, sf_dir):
    c = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", T.avg_sentence_length(c).alias("asl"), T.avg_word_length(c).alias("awl"))
    a, b = F.col("asl"), F.col("awl")
    return d.select("doc_id", six(a, "avg_sentence_length"), six(b, "avg_word_length"), six(T.flesch(a, b), "flesch"), six(T.grade_level(a, b), "grade"))


@query("m31_vocabulary", r"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS ws FROM documents) SELECT doc_id, len(ws)::BIGINT AS total_words, len(list_distinct(ws))::BIGINT AS unique_words, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws))::DOUBLE / len(ws) ELSE 0 END, 6) AS richness FROM w")
def vocabulary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.plain_words(F.col("text")).alias("w"))
    u, n = F.size(F.array_distinct("w")), F.size("w")
    return d.select("doc_id", n.cast("long").alias("total_words"), u.cast("long").alias("unique_words"), six(T.ratio(u.cast("double"), n), "richness"))


def whole_words(patterns: list[str], flags: str = "") -> str:
    """The patterns over the words of any language, which is what word boundaries mean there."""
    plain = [p.replace(r"\b", "").replace(r"\w", r"[\p{L}\p{N}_]") for p in patterns]
    return " + ".join(f"len(list_filter(ws, lambda x: regexp_full_match(x, '{flags}{p}')))" for p in plain)


RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


@query("m32_m33_densities", f"WITH r AS (SELECT doc_id, {WORDS} AS w, {RUNS} AS ws FROM documents), c AS (SELECT doc_id, w, {whole_words(T.TECHNICAL_PATTERNS)} AS t, {whole_words(T.CONCEPT_PATTERNS, '(?i)')} AS c FROM r) SELECT doc_id, round(CASE WHEN w > 0 THEN least(1.0, t::DOUBLE / w) ELSE 0 END, 6) AS technical_density, round(CASE WHEN w > 0 THEN least(1.0, c::DOUBLE / w) ELSE 0 END, 6) AS concept_density FROM c")
def densities(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", six(T.technical_density(c), "technical_density"), six(T.concept_density(c), "concept_density"))


TYPES = ", ".join(f"len(list_filter(ws, lambda x: list_contains({quoted(ws)}, x))) AS {name}" for name, ws in T.CONTENT_TYPES.items())
TOP = f"greatest({', '.join(T.CONTENT_TYPES)})"


@query("m35_content_type", f"WITH r AS (SELECT doc_id, {RUNS.replace('text', 'lower(text)')} AS ws FROM documents), t AS (SELECT doc_id, {TYPES} FROM r) SELECT doc_id, CASE WHEN {TOP} = 0 THEN 'general' {' '.join(f'WHEN {n} = {TOP} THEN {chr(39)}{n}{chr(39)}' for n in T.CONTENT_TYPES)} END AS content_type FROM t")
def content_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_type(F.col("text")).alias("content_type"))


STRUCT = r"""l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM documents),
st AS (SELECT doc_id, len(list_filter(ls, lambda x: starts_with(x, '#')))::BIGINT AS heading_count, coalesce(list_max(list_transform(list_filter(ls, lambda x: starts_with(x, '#')), lambda x: length(regexp_extract(x, '^(#+)', 1)))), 0)::BIGINT AS max_heading_depth,
  len(list_filter(ls, lambda x: regexp_matches(x, '^([-*+]|\d+\.)')))::BIGINT AS list_count, (len(list_filter(ls, lambda x: starts_with(x, '```'))) // 2)::BIGINT AS code_block_count FROM l)"""


@query("m37_structure_counts", f"WITH {STRUCT} SELECT * FROM st")
def structure_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in T.structure_counts(F.col("text")).items()])


FEATURES = rf"""{SENTIMENT}, {READABILITY}, {STRUCT},
dn AS (SELECT doc_id, w, {whole_words(T.TECHNICAL_PATTERNS)} AS t, {whole_words(T.CONCEPT_PATTERNS, '(?i)')} AS c FROM (SELECT doc_id, {WORDS} AS w, {RUNS} AS ws FROM documents)),
ty AS (SELECT doc_id, {TYPES} FROM (SELECT doc_id, {RUNS.replace('text', 'lower(text)')} AS ws FROM documents)),
vo AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS pw FROM documents),
al AS (SELECT doc_id, f.w::BIGINT AS total_words, CASE WHEN {TOP} = 0 THEN 'general' {' '.join(f'WHEN {n} = {TOP} THEN {chr(39)}{n}{chr(39)}' for n in T.CONTENT_TYPES)} END AS content_type, heading_count, max_heading_depth, list_count, code_block_count, score AS sentiment_score, asl AS avg_sentence_length, awl AS avg_word_length,
  CASE WHEN len(pw) > 0 THEN len(list_distinct(pw))::DOUBLE / len(pw) ELSE 0 END AS vocabulary_richness, CASE WHEN dn.w > 0 THEN least(1.0, t::DOUBLE / dn.w) ELSE 0 END AS technical_density, CASE WHEN dn.w > 0 THEN least(1.0, c::DOUBLE / dn.w) ELSE 0 END AS concept_density,
  CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label, flesch AS readability_score, grade AS grade_level FROM f JOIN s USING (doc_id) JOIN st USING (doc_id) JOIN dn USING (doc_id) JOIN ty USING (doc_id) JOIN vo USING (doc_id)),
co AS (SELECT *, list_filter([CASE WHEN readability_score > 0 THEN greatest(0.0, (100 - readability_score) / 100) END, technical_density, concept_density, vocabulary_richness, CASE WHEN avg_sentence_length > 0 THEN least(1.0, avg_sentence_length / 25.0) END, CASE WHEN total_words > 0 THEN 0.0 END], lambda x: x IS NOT NULL) AS p FROM al)"""
ROUNDED = ["sentiment_score", "avg_sentence_length", "avg_word_length", "vocabulary_richness", "technical_density", "concept_density", "readability_score", "grade_level"]


@query("h27_content_features", f"WITH {FEATURES} SELECT doc_id, total_words, content_type, heading_count, max_heading_depth, list_count, code_block_count, sentiment_label, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in ROUNDED)}, round(list_sum(p) / len(p), 6) AS complexity_score FROM co")
def content_features(spark, sf_dir):
    out = N.content_features(texts(spark, sf_dir), "text").drop("text")
    return out.select("doc_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes if c != "doc_id"])


def _nested(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


PLAIN = _nested("content", [(r"^(?s:---\s*\n.*?\n---\s*\n)", ""), (r"#+\s+", ""), (r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (r"\[\[(.*?)\]\]", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), ("`([^`]+)`", r"\1"), (r"(?s)```.*?```", ""), (r"\s+", " ")])


@query("x17_summary", rf"WITH {MARKED}, p AS (SELECT doc_id, trim({PLAIN}) AS t FROM marked) SELECT doc_id, CASE WHEN length(t) > 200 THEN regexp_replace(substr(t, 1, 200), '\s\S*$', '') || '...' ELSE t END AS summary FROM p")
def summary(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.summary(M.body(F.col("content"))).alias("summary"))


@query("x18_clean_for_encoder", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), 'https?://\S+', '[URL]', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[^\p{L}\p{N}\p{M}_\s.,!?;:\-''"(){}\[\]]+', '', 'g')) AS cleaned FROM documents""")
def clean_for_encoder(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_for_encoder(F.col("text")).alias("cleaned"))


@query("x22_clean_markup", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '`(.*?)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_markup(F.col("text")).alias("cleaned"))


@query("x19_truncate", "SELECT doc_id, CASE WHEN length(text) <= 800 THEN text WHEN instr(substr(text, 1, 800), '. ') > 0 AND 800 - instr(reverse(substr(text, 1, 800)), ' .') - 1 > 640 THEN substr(text, 1, 800 - instr(reverse(substr(text, 1, 800)), ' .')) ELSE substr(text, 1, 800) END AS cut FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 800).alias("cut"))


@query("x20_chunks")
def chunks(spark, sf_dir):
    out = M.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "start_pos", "end_pos", "length")


@query("x11_tags", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '#([a-zA-Z0-9_/-]+)', 1))), ',') AS tags FROM documents")
def any_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.any_tags(F.col("text")), ",").alias("tags"))


@query("x12_headings", rf"WITH {MARKED}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM marked) SELECT doc_id, n::BIGINT AS line_number, length(regexp_extract(line, '^(#+)\s+', 1))::BIGINT AS level FROM l WHERE regexp_matches(line, '^(#+)\s+(.*?)(?:\s*#+)?$')")
def headings(spark, sf_dir):
    d = marked(spark, sf_dir).select("doc_id", F.explode(M.headings(F.col("content"))).alias("h"))
    return d.select("doc_id", F.col("h.line_number").cast("long").alias("line_number"), F.col("h.level").cast("long").alias("level"))


@query("x4_page_links", r"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) SELECT target, count(*)::BIGINT AS links FROM u GROUP BY target""")
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return p.groupBy("target").agg(F.count("*").alias("links"))


@query("x30_title_jaccard", r"WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '\s+'), lambda x: x <> '')) AS ws FROM part), p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS s FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1) SELECT a, b, round(CASE WHEN s > i THEN i::DOUBLE / (s - i) ELSE 0 END, 6) AS jaccard FROM p")
def title_jaccard(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), six(T.title_jaccard(F.col("p_type"), F.col("other")), "jaccard"))


@query("x29_path_distance", f"WITH {NOTES}, p AS (SELECT doc_id, string_split(path, '/') AS p FROM notes) SELECT a.doc_id AS a, b.doc_id AS b, (6 - 2 * (CASE WHEN a.p[1] <> b.p[1] THEN 0 WHEN a.p[2] <> b.p[2] THEN 1 WHEN a.p[3] <> b.p[3] THEN 2 ELSE 3 END))::BIGINT AS distance FROM p a JOIN p b ON b.doc_id = a.doc_id + 20")
def path_distance(spark, sf_dir):
    n = notes(spark, sf_dir).select("doc_id", "path")
    m = n.select((F.col("doc_id") - 20).alias("doc_id"), F.col("path").alias("other"))
    return n.join(m, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b"), T.path_distance(F.col("path"), F.col("other")).cast("long").alias("distance"))


TF = rf"""w0_ AS (SELECT doc_id AS id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z][a-zA-Z0-9]*') AND NOT list_contains({quoted(terms.stop_words())}, x)) AS ws FROM documents),
t AS (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w0_),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term) x, n WHERE df >= 2 AND df <= 0.8 * n ORDER BY total DESC, term LIMIT 1000)"""


def _weights(spark, sf_dir):
    d = texts(spark, sf_dir)
    found = terms.documents(d, "doc_id")
    return found, terms.vocabulary(found, d.count())


@query("t2_idf", f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM v")
def idf(spark, sf_dir):
    _, vocab = _weights(spark, sf_dir)
    return vocab.select("term", "df", six(F.col("idf"), "idf"))


WEIGHTS = f"""{TF}, w0 AS (SELECT tf.id, tf.term, tf.tf * v.idf AS w FROM tf JOIN v USING (term)), w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0)"""


@query("o4_top_terms", f"WITH {WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS rank FROM w) SELECT id AS doc_id, rank::BIGINT AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10")
def top_terms(spark, sf_dir):
    found, vocab = _weights(spark, sf_dir)
    return terms.top_terms(terms.weights(found, vocab)).select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "term", six(F.col("weight"), "weight"))


@query("t3_pair_cosine", f"WITH {WEIGHTS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 5) SELECT p.a, p.b, round(coalesce(sum(x.weight * y.weight), 0), 6) AS tfidf_similarity FROM p LEFT JOIN w x ON x.id = p.a LEFT JOIN w y ON y.id = p.b AND y.term = x.term GROUP BY p.a, p.b")
def pair_cosine(spark, sf_dir):
    found, vocab = _weights(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"))
    pairs = d.join(d.select((F.col("a") - 5).alias("a")), "a").select("a", (F.col("a") + 5).alias("b"))
    return terms.pair_cosine(terms.weights(found, vocab), pairs).select("a", "b", six(F.col("tfidf_similarity"), "tfidf_similarity"))


@query("t4_note_tfidf_features", f"WITH {WEIGHTS} SELECT id AS doc_id, round(sum(weight) / (SELECT count(*) FROM v), 6) AS mean_tfidf, round(count(*)::DOUBLE / (SELECT count(*) FROM v), 6) AS vocabulary_share FROM w GROUP BY id")
def note_tfidf(spark, sf_dir):
    found, vocab = _weights(spark, sf_dir)
    n = vocab.count()
    return terms.weights(found, vocab).groupBy(F.col("id").alias("doc_id")).agg(six(F.sum("weight") / n, "mean_tfidf"), six(F.count("*") / n, "vocabulary_share"))


@query("t5_topics")
def lda_topics(spark, sf_dir):
    """Topics of all documents by LDA: how many documents each has, its words and the mean probability."""
    return _topics(spark, sf_dir, "lda")


@query("t6_topics")
def means_topics(spark, sf_dir):
    return _topics(spark, sf_dir, "kmeans")


def _topics(spark, sf_dir, method):
    d = texts(spark, sf_dir)
    model = topics.fit(d, method=method)
    words = spark.createDataFrame([(x["topic"], ",".join(x["words"])) for x in topics.topic_words(model)], "dominant_topic int, words string")
    sizes = topics.topic_sizes(topics.predict(model, d))
    return words.join(sizes, "dominant_topic", "left").select(F.col("dominant_topic").alias("topic"), "words", F.coalesce("documents", F.lit(0)).alias("documents"), six(F.col("probability"), "probability"))
