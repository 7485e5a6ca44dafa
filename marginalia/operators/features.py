"""Features of parsed notes: summary, structure, front matter, relationships, progress, and the note table of them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

# Words that tell kinds of notes, signs of progress and the stages they stand for, front matter fields.
KINDS = {"technical": ["algorithm", "function", "class", "method", "implementation"], "conceptual": ["concept", "theory", "principle", "framework"], "project": ["project", "task", "goal", "objective"]}
STAGES = {"🌱": "seedling", "🌿": "developing", "🌲": "mature", "⚛️": "atomic", "🗺️": "comprehensive", "⧉": "project", "🎓": "educational"}
PROGRESS_FIELDS = ["progress", "state", "status", "stage", "maturity"]
CONCEPT_FIELDS = ["concepts", "keywords", "terms", "topics"]
COUNTED_FIELDS = ["aliases", "domains", "concepts", "sources"]
COUNTED_RELATIONS = ["up", "similar", "leads_to", "extends", "implements"]
DEFINING = ["is", "are", "refers to", "means", "defined as"]
NO_SUMMARY = "Insufficient content for summary"

_NONE = "array<string>"


def listed(value: Column) -> Column:
    """A front matter value as strings: a JSON list, or a text parted by commas."""
    parts = F.when(value.startswith("["), F.from_json(value, _NONE)).otherwise(F.split(value, ","))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast(_NONE))


def structure(content: Column) -> dict[str, Column]:
    """heading_count, max_heading_depth, topics (heading texts), terms (distinct capitalised words), kind and concept_density."""
    c = T.text_of(content)
    heads = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x.rlike(r"^#+\s+.+$"))
    terms = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][A-Za-z]*+)(?![\p{L}\p{N}_])"), F.lit(1)))
    low, kind = F.lower(c), None
    for name, words in KINDS.items():
        hit = low.rlike("|".join(words))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return {
        "heading_count": F.size(heads), "max_heading_depth": F.coalesce(F.array_max(F.transform(heads, lambda x: F.length(F.regexp_extract(x, "^(#+)", 1)))), F.lit(0)),
        "topics": F.transform(heads, lambda x: F.trim(F.regexp_extract(x, r"^#+\s+(.+)$", 1))), "terms": terms, "kind": kind.otherwise("general"),
        "concept_density": T.ratio(F.size(terms).cast("double"), T.word_count(c)),
    }


def key_concepts(content: Column, fields: Column, most: int = 10) -> Column:
    """Front matter concepts and emphasised phrases of at most three words, sorted, so that which ones stay is no matter of chance."""
    c = T.text_of(content)
    strong = F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    light = F.regexp_extract_all(F.regexp_replace(c, r"\*\*[^*]+\*\*", ""), F.lit(r"\*([^*]+)\*"), F.lit(1))
    short = F.filter(F.transform(F.concat(strong, light), lambda x: F.trim(x)), lambda x: F.size(F.split(x, r"\s+")) <= 3)
    own = F.flatten(F.array(*[listed(fields[k]) for k in CONCEPT_FIELDS]))
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.concat(own, short), lambda x: F.length(x) > 2))), 1, most)


def _cut(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def semantic_summary(content: Column, fields: Column, kind: Column, topics: Column, concepts: Column) -> Column:
    """The front matter's summary; else a paragraph with a concept (technical), a sentence that defines one (conceptual), the headings, or the first sentence of some length."""
    c = T.text_of(content)
    named = lambda text: F.exists(concepts, lambda k: F.contains(F.lower(text), F.lower(k)))
    sentences = F.transform(F.split(c, r"\."), _stripped)
    plain = F.filter(sentences, lambda s: (F.length(s) > 20) & ~s.startswith("#"))
    simple = F.coalesce(_cut(F.get(plain, 0)), F.when(F.length(c) > 200, F.concat(_stripped(F.substring(c, 1, 200)), F.lit("..."))).otherwise(_stripped(c)))
    tidy = lambda s: T.collapse(F.regexp_replace(s, r"#+\s*", ""))
    paragraph = F.get(F.filter(F.transform(F.split(c, "\n\n"), _stripped), lambda p: (F.length(p) > 50) & named(p)), 0)
    technical = F.coalesce(_cut(tidy(F.regexp_replace(paragraph, r"\*\*([^*]+)\*\*", "$1"))), simple)
    defining = F.get(F.filter(sentences, lambda s: (F.length(s) > 30) & F.lower(s).rlike("|".join(DEFINING)) & named(s)), 0)
    conceptual = F.coalesce(_cut(tidy(defining)), simple)
    general = F.when(F.size(topics) > 0, F.concat(F.lit("Note covering: "), F.array_join(F.slice(topics, 1, 3), ", "))).otherwise(simple)
    made = F.when(kind == "technical", technical).when(kind == "conceptual", conceptual).otherwise(general)
    told = _stripped(fields["summary"])
    return F.when(F.length(told) > 0, told).when(F.length(_stripped(c)) < 50, NO_SUMMARY).otherwise(made)


def progress(tags: Column, fields: Column) -> Column:
    """Signs of progress among the tags and the fields that tell a state, tags first, each once."""
    signs = F.array(*[F.lit(x) for x in STAGES])
    told = F.array(*[fields[k] for k in PROGRESS_FIELDS])
    return F.array_distinct(F.filter(F.concat(F.coalesce(tags, F.array().cast(_NONE)), told), lambda x: F.array_contains(signs, x)))


def quality_stage(fields: Column, signs: Column) -> Column:
    """The stage that the front matter tells, or the first sign of progress stands for, or `unknown`."""
    named = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.coalesce(F.when(fields["quality_stage"] != "", fields["quality_stage"]), named[F.get(signs, 0)], F.lit("unknown"))


def frontmatter_features(fields: Column, signs: Column) -> dict[str, Column]:
    out = {f"{k}_count": F.size(listed(fields[k])) for k in COUNTED_FIELDS}
    return out | {"has_summary_field": F.coalesce(F.length(F.trim(fields["summary"])) > 0, F.lit(False)), "progress_state": F.coalesce(F.get(signs, 0), F.lit("unknown"))}


def relationship_counts(relationships: Column) -> dict[str, Column]:
    return {f"semantic_{k}_links": F.coalesce(F.size(relationships[k]), F.lit(0)) for k in COUNTED_RELATIONS}


def flattened(fields: Column) -> Column:
    """map<string, string>: a list under its key with _list, _count and _str, a nested map's values under key_inner, others as they are."""

    def one(k: Column, v: Column) -> Column:
        items = F.from_json(v, _NONE)
        as_list = F.array(F.struct(F.concat(k, F.lit("_list")).alias("k"), v.alias("v")), F.struct(F.concat(k, F.lit("_count")).alias("k"), F.size(items).cast("string").alias("v")), F.struct(F.concat(k, F.lit("_str")).alias("k"), F.array_join(items, ", ").alias("v")))
        inner = F.transform(F.map_entries(F.from_json(v, "map<string, string>")), lambda e: F.struct(F.concat(k, F.lit("_"), e["key"]).alias("k"), e["value"].alias("v")))
        return F.when(v.startswith("["), as_list).when(v.startswith("{"), inner).otherwise(F.array(F.struct(k.alias("k"), v.alias("v"))))

    entries = F.flatten(F.transform(F.map_entries(fields), lambda e: one(e["key"], e["value"])))
    return F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull()))


def note_features(parsed: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """One row a note with the columns of the note table, from (path, stem, content, size, modified, tags, links, fields, relationships) and, by id, in_degree and centralities."""
    signs = progress(F.col("tags"), F.col("fields"))
    s = structure(F.col("content"))
    out = parsed.withColumns({"f_signs": signs, "f_concepts": key_concepts(F.col("content"), F.col("fields")), **{f"f_{k}": v for k, v in s.items()}})
    words = T.word_count(F.col("content"))
    out = out.select(
        F.col("path").alias("id"), F.col("stem").alias("note_title"), words.alias("word_count"), F.size("tags").alias("tag_count"), quality_stage(F.col("fields"), F.col("f_signs")).alias("quality_stage"), F.col("modified").alias("last_modified"),
        F.size("links").alias("outgoing_links_count"), semantic_summary(F.col("content"), F.col("fields"), F.col("f_kind"), F.col("f_topics"), F.col("f_concepts")).alias("semantic_summary"), F.col("size").alias("file_size"), (words / 200.0).alias("reading_time_minutes"),
        *[c.alias(k) for k, c in frontmatter_features(F.col("fields"), F.col("f_signs")).items()], *[c.alias(k) for k, c in relationship_counts(F.col("relationships")).items()],
        F.col("f_heading_count").alias("heading_count"), F.col("f_max_heading_depth").alias("max_heading_depth"), (F.size("f_terms") / F.greatest(words, F.lit(1))).alias("technical_term_density"), F.col("f_concept_density").alias("concept_density_score"),
    )
    if graph is None:
        return out
    numbers = {c: 0.0 for c in graph.columns if c != "id"}
    return out.join(graph, "id", "left").na.fill(numbers)
