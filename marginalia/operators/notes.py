"""Note-level features, quality assessment and collection structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.sources.vault import prefixes

# Folder words and name patterns of ways to organise notes.
PARA_FOLDERS = ["projects", "areas", "resources", "archive", "inbox"]
PARA_PATTERNS = [r"^\d+\.\s*projects?", r"^\d+\.\s*areas?", r"^\d+\.\s*resources?", r"^\d+\.\s*archive", r"inbox|capture"]
DECIMAL_PATTERNS = [r"^\d{2}[-\s]", r"^\d{2}\.\d{2}", r"^\d{1,2}[-\s]\d{1,2}[-\s]"]
ZETTEL_PATTERNS = [r"^\d{12,14}", r"^\d{4}\.\d{2}\.\d{2}", r"^[A-Z]{1,3}\d{3,6}"]
DATE_PATTERNS = [r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{4}[-/]\d{1,2}", r"\d{4}"]


# Texts of advice and of what is found lacking, which readers of the results look for.
SUGGESTIONS = [
    "Expand content with more detailed explanations",
    "Add headers to organize content structure",
    "Break content into more paragraphs for readability",
    "Use headers to create clear content hierarchy",
    "Use bullet points or numbered lists for key information",
    "Add relevant tags for better categorization",
    "Link to related notes to create connections",
    "Add more links to related concepts and notes",
    "Fix broken links to maintain note connectivity",
    "Review and update content to maintain relevance",
    "Complete or organize TODO items",
]
ISSUES = ["Content too short", "Missing headers", "No outbound links", "Broken links present", "Content is stale", "No tags for categorization"]


def content_features(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """Sentiment, readability, vocabulary, densities, type, complexity and structure of each text; null is empty.

    A text is cut once into words, runs of letters and marked lines, and all
    counts are of these.
    """
    c = F.col(text_col)
    out = notes.withColumn("c_low", F.lower(T.text_of(c)))
    out = out.withColumns({"c_words": T.words(c), "c_low_words": T.words(F.col("c_low")), "c_runs": T.runs(c), "c_low_runs": T.runs(F.col("c_low")), "c_lines": T.marked_lines(c), "c_sentences": T.sentence_count(c)})
    out = out.withColumns({"c_letters": T.letters_of(F.col("c_runs")), "c_typed": T.typed_of(F.col("c_low_runs"))})
    out = out.withColumns({
        "total_words": F.size("c_words"), "c_solid": F.length(F.array_join("c_words", "")), "c_good": F.size(T.among(F.col("c_low_words"), T.POSITIVE)), "c_bad": F.size(T.among(F.col("c_low_words"), T.NEGATIVE)),
        "c_plain": T.plain_of(F.col("c_low_runs")), "c_technical": T.technical_of(F.col("c_runs")), "c_concept": T.concept_of(F.col("c_letters")), "content_type": T.type_of(F.col("c_typed")), **T.structure_of(F.col("c_lines")),
    })
    n = F.col("total_words")
    out = out.withColumns({
        "sentiment_score": T.sentiment_of(F.col("c_good"), F.col("c_bad"), n), "avg_sentence_length": T.ratio(n.cast("double"), F.col("c_sentences")), "avg_word_length": T.ratio(F.col("c_solid").cast("double"), n),
        "vocabulary_richness": T.richness_of(F.col("c_plain")), "technical_density": T.density(F.col("c_technical"), n), "concept_density": T.density(F.col("c_concept"), n),
    })
    out = out.drop("c_low", "c_words", "c_low_words", "c_runs", "c_low_runs", "c_lines", "c_letters", "c_typed", "c_sentences", "c_solid", "c_good", "c_bad", "c_plain", "c_technical", "c_concept")
    out = out.withColumns({"sentiment_label": T.sentiment_label(F.col("sentiment_score")), "readability_score": T.flesch(F.col("avg_sentence_length"), F.col("avg_word_length")), "grade_level": T.grade_level(F.col("avg_sentence_length"), F.col("avg_word_length"))})
    return out.withColumn("complexity_score", T.complexity(F.col("readability_score"), F.col("technical_density"), F.col("concept_density"), F.col("vocabulary_richness"), F.col("avg_sentence_length"), F.col("total_words")))


def content_structure(content: Column) -> dict[str, Column]:
    """Counts that quality is scored on."""
    c = T.text_of(content)
    heads = F.regexp_extract_all(c, F.lit(r"(?m)^(#{1,6})\s+.+"), F.lit(1))
    words = T.regex_word_count(c)
    paragraphs = F.size(F.filter(F.split(c, "\n\n"), lambda p: p.rlike(r"\S")))
    return {
        "words": words, "headers": F.size(heads), "levels": F.size(F.array_distinct(F.transform(heads, lambda h: F.length(h)))),
        "lists": T.count_of(c, r"(?m)^\s*[-*+]\s+.+|^\s*\d+\.\s+.+"), "links": T.count_of(c, r"\[\[([^\]]+)\]\]|\[([^\]]+)\]\([^)]+\)"),
        "tags": T.count_of(c, r"#[a-zA-Z][a-zA-Z0-9_/-]*"), "code": T.count_of(c, r"(?s)```.*?```|`[^`]+`"), "todos": T.count_of(c, r"- \[ \]|TODO:|FIXME:|NOTE:"),
        "reading": F.greatest(F.lit(1.0), words / 200.0), "paragraphs": paragraphs, "paragraph_length": words / F.greatest(F.lit(1), paragraphs),
    }


def connection_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, outbound, inbound, mutual, broken, density, hub, authority; edges to ids that are no nodes are broken."""
    total = F.broadcast(nodes.agg((F.count("*") - 1).alias("_n")))  # one row
    e = edges.select("src", "dst").distinct().where("src <> dst")
    known = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    out = known.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outbound"))
    into = known.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    back = known.join(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("mutual"))
    lost = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("broken"))
    all_ = nodes.select("id").join(out, "id", "left").join(into, "id", "left").join(back, "id", "left").join(lost, "id", "left").na.fill(0)
    n = F.greatest(F.lit(1), F.col("_n"))
    return all_.join(total).select("id", "outbound", "inbound", "mutual", "broken", ((F.col("outbound") + F.col("inbound")) / n).alias("density"), F.least(F.lit(1.0), F.col("outbound") / F.greatest(F.lit(1.0), 0.1 * F.col("_n"))).alias("hub"), F.least(F.lit(1.0), F.col("inbound") / F.greatest(F.lit(1.0), 0.05 * F.col("_n"))).alias("authority"))


def assess(notes: DataFrame, as_of, connections: DataFrame | None = None, id_col: str = "path") -> DataFrame:
    """Scores, level, domain, suggestions, issues, confidence, gap and effort of each note (content, path, modified).

    Without connections, links in the content stand in for outbound edges.
    """
    m = content_structure(F.col("content"))
    out = notes.withColumns({f"m_{k}": v for k, v in m.items()})
    m = {k: F.col(f"m_{k}") for k in m}
    if connections is None:
        links = F.col("m_links")
        out = out.withColumns({"outbound": links, "inbound": F.lit(0), "mutual": F.lit(0), "broken": F.lit(0), "density": F.least(F.lit(0.1), links / 50.0)})
    else:
        out = out.join(connections.withColumnRenamed("id", id_col), id_col, "left").na.fill(0, ["outbound", "inbound", "mutual", "broken", "density"])
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.col("modified").cast("timestamp").cast("double")) / 86400.0
    out = out.withColumns({"completeness": S.completeness(m), "structure": S.structure(m), "connections": S.connections(F.col("outbound"), F.col("inbound"), F.col("mutual"), F.col("density"), F.col("broken")), "freshness": S.freshness(age)})
    out = out.withColumn("overall", S.overall(F.col("completeness"), F.col("structure"), F.col("connections"), F.col("freshness")))
    words, heads, tags, outbound, broken = m["words"], m["headers"], m["tags"], F.col("outbound"), F.col("broken")
    told = lambda pairs: F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]), lambda x: x.isNotNull())
    complete, structured = F.col("completeness") < 0.5, F.col("structure") < 0.5
    suggestions = told([
        (complete & (words < 100), SUGGESTIONS[0]), (complete & (heads == 0), SUGGESTIONS[1]), (complete & (m["paragraphs"] < 3), SUGGESTIONS[2]),
        (structured & (heads < 2), SUGGESTIONS[3]), (structured & (m["lists"] == 0), SUGGESTIONS[4]), (structured & (tags == 0), SUGGESTIONS[5]),
        ((F.col("connections") < 0.3) & (outbound == 0), SUGGESTIONS[6]), ((F.col("connections") < 0.3) & outbound.between(1, 2), SUGGESTIONS[7]),
        ((F.col("connections") < 0.3) & (broken > 0), SUGGESTIONS[8]), (F.col("freshness") < 0.4, SUGGESTIONS[9]), (m["todos"] > 0, SUGGESTIONS[10]),
    ])
    issues = told([(words < 50, ISSUES[0]), (heads == 0, ISSUES[1]), (outbound == 0, ISSUES[2]), (broken > 0, ISSUES[3]), (F.col("freshness") < 0.3, ISSUES[4]), (tags == 0, ISSUES[5])])
    has = lambda t: F.array_contains(F.col("issues"), t)
    graph = F.lit(0.1 if connections is not None else -0.1)
    confidence = S.clamp(0.7 + F.when(words >= 200, 0.1).when(words < 50, -0.2).otherwise(0.0) + graph + F.when((words < 20) | (words > 5000), -0.1).otherwise(0.0), 0.1)
    potential = F.least(F.lit(1.0), F.col("overall") + F.when(words < 200, 0.2).otherwise(0.0) + F.when(heads < 2, 0.1).otherwise(0.0) + F.when(outbound < 3, 0.15).otherwise(0.0) + F.when(tags == 0, 0.05).otherwise(0.0))
    out = out.withColumns({"level": S.quality_level(F.col("overall")), "domain": S.domain(F.col("path"), F.col("content")), "suggestions": F.slice(suggestions, 1, 5), "issues": issues, "confidence": confidence, "potential": potential})
    gap = F.when(has("Content too short"), "completeness").when(has("Missing headers") | has("No tags for categorization"), "structure").when(has("No outbound links") | has("Broken links present"), "connections").when(has("Content is stale"), "freshness").otherwise("general")
    return out.withColumns({"gap_type": gap, "priority": F.when(F.col("overall") < 0.2, "high").when(F.col("overall") < 0.4, "medium").otherwise("low"), "effort": F.when(F.size("issues") >= 4, "2h").when(F.size("issues") >= 2, "30min").otherwise("10min")})


def quality_gaps(assessed: DataFrame, limit: int = 50) -> DataFrame:
    """Notes with most to gain, high priority first; ties by path."""
    gain = F.col("potential") - F.col("overall")
    return assessed.where(F.size("issues") > 0).withColumn("improvement", gain).orderBy(F.col("priority") != "high", F.round("improvement", 9).desc(), "path").limit(limit)


def depth_metrics(notes: DataFrame) -> DataFrame:
    """max_depth, avg_depth, variety, evenness (entropy over its maximum), complexity and organisation of path depths."""
    d = notes.select(F.size(T.path_parts(F.col("path"))).alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))
    total = d.withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))  # as many rows as there are depths
    p = F.col("n") / F.col("all")
    a = total.agg(F.max("depth").alias("max_depth"), (F.sum(F.col("depth") * F.col("n")) / F.sum("n")).alias("avg_depth"), F.count("*").alias("variety"), (-F.sum(p * F.log2(p))).alias("h"))
    a = a.withColumn("evenness", F.when(F.col("variety") > 1, F.col("h") / F.log2(F.col("variety").cast("double"))).otherwise(0.0)).drop("h")
    complexity = F.least(F.lit(1.0), F.col("max_depth") / 10.0 * 0.4 + F.col("variety") / 8.0 * 0.3 + F.col("evenness") * 0.3)
    penalty = F.when(F.col("avg_depth") < 1.5, 0.2).when(F.col("avg_depth") > 5.0, 0.3).when(F.col("max_depth") > 8, 0.2).otherwise(0.0)
    return a.withColumns({"complexity": complexity, "organization": S.clamp(0.7 - penalty + F.col("evenness") * 0.3)})


def organisation(notes: DataFrame) -> DataFrame:
    """One row: score of each way to organise, the method that is told and its confidence."""
    folders = notes.select(F.explode(prefixes(F.col("path"))).alias("folder")).distinct().select(F.lower(F.element_at(F.split("folder", "/"), -1)).alias("name"))
    hit = lambda c, p: F.max(c.rlike("(?i)" + p).cast("int"))
    n = F.col("name")
    topic = ~n.rlike(r"^\d+") & ~n.rlike(r"\d{4}[-/]\d{1,2}") & ~n.startswith(".") & (F.length(n) > 2)
    f = folders.agg(
        F.count("*").alias("folders"), F.sum(topic.cast("int")).alias("topics"),
        sum([F.coalesce(F.max(n.contains(x).cast("int")), F.lit(0)) for x in PARA_FOLDERS], F.lit(0)).alias("para"),
        sum([F.coalesce(hit(n, x), F.lit(0)) for x in PARA_PATTERNS], F.lit(0)).alias("para_patterns"), sum([F.coalesce(hit(n, x), F.lit(0)) for x in DECIMAL_PATTERNS], F.lit(0)).alias("decimal"),
    )
    file = F.element_at(F.split("path", "/"), -1)
    g = notes.agg(
        F.count("*").alias("files"), sum([F.sum(file.rlike("(?i)" + p).cast("int")) for p in ZETTEL_PATTERNS], F.lit(0)).alias("zettel"),
        sum([F.sum(F.col("path").rlike(p).cast("int")) for p in DATE_PATTERNS], F.lit(0)).alias("dates"), sum([F.coalesce(hit(file, p), F.lit(0)) for p in DECIMAL_PATTERNS], F.lit(0)).alias("decimal_files"),
    )
    out = g.join(F.broadcast(f))  # one row each
    share = F.col("topics") / F.col("folders")
    z, dates = F.col("zettel") / F.col("files"), F.col("dates") / F.col("files")
    above = lambda c, steps: F.when(c > steps[0][0], steps[0][1]).when(c > steps[1][0], steps[1][1]).when(c > steps[2][0], steps[2][1])
    out = out.withColumns({
        "s_para": F.least(F.lit(1.0), S.tiers(F.col("para"), [(3, 0.6), (2, 0.4), (1, 0.2)]) + F.least(F.lit(0.4), 0.2 * F.col("para_patterns"))),
        "s_johnny_decimal": F.least(F.lit(1.0), S.tiers(F.col("decimal"), [(2, 0.7), (1, 0.4)]) + F.least(F.lit(0.3), 0.1 * F.col("decimal_files"))),
        "s_zettelkasten": above(z, [(0.5, 0.8), (0.3, 0.6), (0.1, 0.3)]).when(F.col("zettel") > 0, 0.1).otherwise(0.0),
        "s_topic_based": above(share, [(0.7, 0.6), (0.5, 0.4), (0.3, 0.2)]).otherwise(0.0), "s_chronological": above(dates, [(0.4, 0.7), (0.2, 0.4), (0.1, 0.2)]).otherwise(0.0),
    })
    names = ["para", "johnny_decimal", "zettelkasten", "topic_based", "chronological"]
    best = F.greatest(*[F.col(f"s_{x}") for x in names])
    high = sum([(F.col(f"s_{x}") > 0.3).cast("int") for x in names], F.lit(0))
    named = F.when(high > 1, "mixed").when(best < 0.2, "unknown")
    for x in names:
        named = named.when(F.col(f"s_{x}") == best, x)
    out = out.withColumns({"method": named, "confidence": F.when(high > 1, F.greatest(F.lit(0.4), best * 0.8)).when(best < 0.2, 0.1).otherwise(best)})
    return out.select(*[f"s_{x}" for x in names], "method", "confidence")


def directory_clusters(notes: DataFrame, limit: int = 20) -> DataFrame:
    """folder, files, depths, keywords (the five commonest words of the names) and coherence, of folders with two files or more."""
    parts = T.path_parts(F.col("path"))
    n = notes.select("folder", F.size(parts).alias("depth"), F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")).alias("stem"))
    per = n.groupBy("folder").agg(F.count("*").alias("files"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth")).where("files >= 2")
    own = per.select("folder", F.lower(F.element_at(F.split("folder", "/"), -1)).alias("stem"))
    words = n.join(per.select("folder"), "folder", "left_semi").select("folder", "stem").unionByName(own).select("folder", F.explode(F.filter(F.split("stem", r"[-_\s.]+"), lambda w: F.length(w) > 2)).alias("word"))
    counted = words.groupBy("folder", "word").agg(F.count("*").alias("k"))
    best = counted.withColumn("rn", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("k").desc(), "word"))).where("rn <= 5")
    keys = best.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]).alias("keywords"))
    out = per.join(keys, "folder", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    out = out.withColumn("coherence", F.least(F.lit(1.0), F.size("keywords") / F.greatest(F.lit(3.0), F.col("files") * 0.5)))
    return out.orderBy(F.col("coherence").desc(), "folder").limit(limit)


def folder_hierarchy(notes: DataFrame) -> DataFrame:
    """folders, max and mean depth, roots: one row."""
    f = notes.select(F.explode(prefixes(F.col("path"))).alias("folder")).distinct().withColumn("depth", F.size(T.path_parts(F.col("folder"))))
    return f.agg(F.count("*").alias("folders"), F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_depth"), F.sum((F.col("depth") == 1).cast("long")).alias("roots"))


def analysis_summary(features: DataFrame) -> DataFrame:
    """Content features as levels."""
    level = lambda c, high, medium, names=("high", "medium", "low"): F.when(F.col(c) > high, names[0]).when(F.col(c) > medium, names[1]).otherwise(names[2])
    return features.withColumns({
        "complexity_level": level("complexity_score", 0.7, 0.4), "readability_level": level("readability_score", 70, 50, ("easy", "moderate", "difficult")), "technical_content": F.col("technical_density") > 0.1,
        "structure_richness": level("heading_count", 5, 2), "vocabulary_level": level("vocabulary_richness", 0.7, 0.5),
    })


def connection_groups(outbound: DataFrame, least: int = 3) -> DataFrame:
    """cluster, centroid (the first path), notes, coherence, keyword: notes of (path, outbound) with like numbers of links, five to a step."""
    g = outbound.withColumn("cluster", F.floor(F.col("outbound") / 5))
    out = g.groupBy("cluster").agg(F.min("path").alias("centroid"), F.count("*").alias("notes")).where(F.col("notes") >= least)
    return out.select("cluster", "centroid", "notes", F.lit(0.7).alias("coherence"), F.concat(F.lit("group_"), F.col("cluster").cast("string")).alias("keyword"))


def description(notes: Column, keywords: Column) -> Column:
    """A cluster in words, by its first three keywords."""
    top = F.slice(keywords, 1, 3)
    many = F.concat(F.lit("Notes about "), F.array_join(F.slice(top, F.lit(1), F.greatest(F.lit(0), F.size(top) - 1)), ", "), F.lit(" and "), F.element_at(top, -1))
    return F.when(F.size(top) >= 2, many).when(F.size(top) == 1, F.concat(F.lit("Notes about "), F.get(top, 0))).otherwise(F.concat(F.lit("Cluster of "), notes.cast("string"), F.lit(" related notes")))


def para_exceptions(notes: DataFrame, sample: int = 10, most: int = 5) -> DataFrame:
    """Paths among the first ones that are in none of the PARA folders."""
    first = notes.select("path").orderBy("path").limit(sample)
    return first.where(~F.lower("path").rlike("|".join(PARA_FOLDERS))).orderBy("path").limit(most)


def related(content: Column, most: int = 5) -> Column:
    """Targets of the first links that are no web addresses."""
    found = F.regexp_extract_all(T.text_of(content), F.lit(r"(\[\[[^\]]+\]\]|\[[^\]]+\]\([^)]+\))"), F.lit(1))
    target = F.transform(found, lambda x: F.when(x.startswith("[["), F.regexp_extract(x, r"^\[\[([^\]]+)\]\]", 1)).otherwise(F.regexp_extract(x, r"^\[([^\]]+)\]", 1)))
    return F.slice(F.filter(target, lambda x: ~x.startswith("http")), 1, most)


def context_summary(notes: DataFrame, parts: int, graph: bool, vectors: bool, sized: int = 100) -> DataFrame:
    """notes, size (of the first ones by path) and confidence: the share of the three analyses that worked, and a tenth each for a graph and for vectors."""
    size = notes.select("path", "size").orderBy("path").limit(sized).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return notes.agg(F.count("*").alias("notes")).join(F.broadcast(size)).withColumn("confidence", F.lit(min(1.0, parts / 3 + 0.1 * graph + 0.1 * vectors)))  # one row each


def recommendations(organised: float, gaps: DataFrame, limit: int = 5) -> list[dict]:
    """What to do about a vault, from the confidence of its organisation and its quality gaps."""
    out = []
    if organised < 0.5:
        out.append({"title": "Choose one way to organise the folders", "priority": "medium", "category": "organization", "impact": 0.7, "confidence": 0.8})
    high = gaps.where("priority = 'high'").count()
    if high:
        out.append({"title": "Mend the notes with most to gain", "priority": "high", "category": "quality", "impact": 0.8, "confidence": 0.9, "notes": high})
    return out[:limit]


def sampled(notes: DataFrame, most: int, seed: int = 42, above: int = 0) -> DataFrame:
    """The notes whose hashes with a seed are least, or all of them if there are at most `above`."""
    if above and notes.count() <= above:
        return notes
    return notes.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "path")), "path").limit(most)
