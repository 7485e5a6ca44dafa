"""Links of notes as edges: extraction, resolution against the files, statistics, graph sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import markdown as M


def extracted(notes: DataFrame) -> DataFrame:
    """source, raw, link_type: each link of (path, content) once per source, raw target and type."""
    return notes.select(F.col("path").alias("source"), F.explode(M.typed_links(F.coalesce("content", F.lit("")))).alias("l")).select("source", F.col("l.target").alias("raw"), F.col("l.link_type").alias("link_type")).distinct()


def resolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds target and valid: targets with a folder follow it from their source; bare names match a file's name in any case, the least path if several do; `.md` is added where it is missing."""
    files = notes.select("path").distinct()
    plain = F.regexp_replace("raw", "#.*$", "")
    bare = ~plain.contains("/") & (plain != "")
    named = F.lower(M.normalise_target(plain))
    by_name = files.groupBy(F.lower(F.element_at(F.split("path", "/"), -1)).alias("_name")).agg(F.min("path").alias("_found"))
    out = links.withColumn("_name", F.when(bare, named)).join(by_name, "_name", "left")
    target = F.when(bare, F.coalesce("_found", M.normalise_target(plain))).otherwise(M.normalise_target(M.resolve_link(F.col("source"), F.col("raw"))))
    out = out.withColumn("target", target).drop("_name", "_found")
    return out.join(files.select(F.col("path").alias("target"), F.lit(True).alias("valid")), "target", "left").withColumn("valid", F.coalesce("valid", F.lit(False))).select("source", "raw", "link_type", "target", "valid")


def edges(resolved_links: DataFrame) -> DataFrame:
    """src, dst, link_type: valid links between different notes, parallel ones as one."""
    return resolved_links.where("valid and source <> target").groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.max("link_type").alias("link_type"))


def statistics(resolved_links: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: total, targets, broken, to itself, both ways, most and mean outgoing links, notes without links."""
    per = notes.select("path").distinct().join(resolved_links.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("k")), "path", "left").na.fill(0, ["k"])
    out = per.agg(F.max("k").alias("max_outgoing"), F.avg("k").alias("avg_outgoing"), F.sum((F.col("k") == 0).cast("long")).alias("notes_without_links"))
    r = resolved_links
    total = r.agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"), F.coalesce(F.sum((~F.col("valid")).cast("long")), F.lit(0)).alias("broken"), F.coalesce(F.sum((F.col("source") == F.col("target")).cast("long")), F.lit(0)).alias("self_links"))
    e = edges(r).select("src", "dst")
    both = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg((F.count("*") / 2).cast("long").alias("both_ways"))
    return total.join(F.broadcast(out)).join(F.broadcast(both))  # one row each


def by_type(resolved_links: DataFrame) -> DataFrame:
    return resolved_links.groupBy("link_type").agg(F.count("*").alias("links"))


def acceptable(resolved_links: DataFrame, most_broken: float = 0.5) -> bool:
    """False if more than that share of the links is broken."""
    r = resolved_links.agg(F.avg((~F.col("valid")).cast("double"))).first()[0]
    return r is None or r <= most_broken


def graph_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, title) and edges (src, dst, rel_type, original_type) of parsed notes: tags, links and relationships; targets that are no notes become placeholders titled by their alias or name."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.md$", "")
    notes = parsed.select(F.col("path").alias("id"), F.lit("Note").alias("kind"), stem(F.col("path")).alias("title"))
    tagged = parsed.select(F.col("path").alias("src"), F.explode("tags").alias("dst"))
    tags = tagged.select(F.col("dst").alias("id"), F.lit("Tag").alias("kind"), F.col("dst").alias("title")).distinct()
    linked = parsed.select(F.col("path").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.target").alias("dst"), F.col("l.alias").alias("alias"))
    related = parsed.select(F.col("path").alias("src"), F.explode("relationships").alias("k", "v")).select("src", F.explode("v").alias("dst"), "k")
    e = tagged.select("src", "dst", F.lit("HAS_TAG").alias("rel_type"), F.lit("tag").alias("original_type")).unionByName(linked.select("src", "dst", F.lit("LINKS_TO").alias("rel_type"), F.lit("link").alias("original_type"))).unionByName(related.select("src", "dst", F.upper("k").alias("rel_type"), F.col("k").alias("original_type"))).distinct()
    names = linked.select(F.col("dst").alias("id"), "alias").unionByName(related.select(F.col("dst").alias("id"), F.lit(None).cast("string").alias("alias"))).groupBy("id").agg(F.max("alias").alias("alias"))
    missing = names.join(notes.select("id"), "id", "left_anti").select("id", F.lit("Note").alias("kind"), F.coalesce("alias", stem(F.col("id"))).alias("title"))
    return notes.unionByName(missing).unionByName(tags), e


def named_links(content: Column) -> dict[str, Column]:
    """Tags, reference links and web addresses of a text, in order."""
    c = F.coalesce(content, F.lit(""))
    return {
        "tag_links": F.regexp_extract_all(c, F.lit(r"(?m)(?:^|[\s(])#([a-zA-Z0-9_/-]+)(?=[\s).,!?;:]|$)"), F.lit(1)), "reference_links": F.regexp_extract_all(c, F.lit(r"\[[^\]]+\]\[([^\]]+)\]"), F.lit(1)),
        "url_links": F.regexp_extract_all(c, F.lit(r"(https?://[^\s)]+)"), F.lit(1)),
    }


def outgoing(content: Column) -> Column:
    """Targets of wikilinks without their aliases, in order."""
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))


def distinct_values(parsed: DataFrame, column: str) -> DataFrame:
    """The different values of an array column over all notes, sorted."""
    return parsed.select(F.explode(column).alias("value")).distinct().orderBy("value")
