"""Markdown notes: front matter, links, tags, headings, callouts and block references.

Patterns that need no state are column expressions. Offsets of links, callouts
and chunks need a walk over the text and run as Arrow UDFs on whole batches.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

# Patterns and keys of the note format.
FRONTMATTER = r"^---\s*\n(.*?)\n---\s*\n"
#: What \s means in Python, for Java.
_SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WIKILINK = r"\[\[([^\]|]*)(?:\|([^\]]*))?\]\]"
HEADING = r"^(#+)\s+(.*?)(?:\s*#+)?$"
INLINE_TAG = r"(?:^|\s)#([a-zA-Z0-9_/-]+)(?:\s|$)"
ANY_TAG = r"#([a-zA-Z0-9_/-]+)"
CALLOUT = r"^\s*>\s*\[!([a-zA-Z]+)\](.*?)$"
BLOCK_REFERENCE = r"\^([a-zA-Z0-9_-]+)$"
RELATIONS = ["up", "similar", "leads_to", "contradicts", "extends", "implements", "see_also", "relates_to", "depends_on", "inspired_by"]
EMBED = r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
INLINE_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"


def _rows(**fields: Y.DataType) -> Y.ArrayType:
    return Y.ArrayType(Y.StructType([Y.StructField(k, v) for k, v in fields.items()]))


def frontmatter_text(content: Column) -> Column:
    return F.regexp_extract(content, "(?s)" + FRONTMATTER, 1)


def body(content: Column) -> Column:
    return F.regexp_replace(content, "(?s)" + FRONTMATTER, "")


def _flat(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False)


def frontmatter(content: Column) -> Column:
    """Keys of the YAML front matter; values that are no strings as JSON. Broken or missing front matter is empty.

    Only the front matter goes to Python, so that workers hold none of the texts.
    """
    return _yaml_fields(F.regexp_extract(content, "(?s)" + FRONTMATTER.replace(r"\s", _SPACE), 0))


@F.pandas_udf(Y.MapType(Y.StringType(), Y.StringType()))
def _yaml_fields(content: pd.Series) -> pd.Series:
    import yaml

    def one(text: str | None) -> dict:
        m = re.match(FRONTMATTER, text or "", re.S)
        if not m:
            return {}
        try:
            found = yaml.safe_load(m[1])
        except yaml.YAMLError:
            return {}
        return {str(k): _flat(v) for k, v in found.items()} if isinstance(found, dict) else {}

    return content.map(one)


def normalise_target(target: Column) -> Column:
    return F.when(F.lower(target).endswith(".md"), target).otherwise(F.concat(target, F.lit(".md")))


def wikilinks(content: Column) -> Column:
    """array<struct<target, alias, section, block_ref>>; targets end in .md, empty parts are null."""
    whole = F.regexp_extract_all(content, F.lit(r"(\[\[[^\]]*\]\])"), F.lit(1))

    def parts(link: Column) -> Column:
        inner, alias = F.regexp_extract(link, WIKILINK, 1), F.regexp_extract(link, WIKILINK, 2)
        target = F.regexp_extract(inner, r"^([^#^]*)", 1)
        null = lambda c: F.when(c != "", c)
        return F.struct(normalise_target(F.trim(target)).alias("target"), null(alias).alias("alias"), null(F.regexp_extract(inner, r"#([^^]*)", 1)).alias("section"), null(F.regexp_extract(inner, r"\^(.*)$", 1)).alias("block_ref"))

    return F.transform(whole, parts)


def typed_links(content: Column) -> Column:
    """array<struct<link_type, target>>: wikilinks, embeds (which are wikilinks too) and inline links to files."""
    of = lambda kind, pattern: F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("link_type"), t.alias("target")))
    return F.filter(F.concat(of("wikilink", r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), of("markdown_link", INLINE_LINK), of("embedded_link", EMBED)), lambda x: ~x["target"].rlike(r"^(https?|ftp|mailto):"))


def inline_tags(content: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(INLINE_TAG), F.lit(1))))


def any_tags(content: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(ANY_TAG), F.lit(1))))


def tags(content: Column, fields: Column) -> Column:
    """Front matter tags, tag, category and categories together with inline tags, sorted."""
    own = F.flatten(F.array(*[_listed(fields[k]) for k in ("tags", "tag", "category", "categories")]))
    return F.array_sort(F.array_distinct(F.concat(own, F.regexp_extract_all(body(content), F.lit(INLINE_TAG), F.lit(1)))))


def _listed(value: Column) -> Column:
    """A front matter value as an array of strings."""
    parsed = F.from_json(value, "array<string>")
    whole = F.when(value.startswith("["), parsed).otherwise(F.array(value))
    return F.coalesce(F.filter(whole, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def relationships(fields: Column) -> Column:
    """map<relation, array<target>> of the relation keys that are set; `up::` counts as `up`, targets end in .md."""

    def targets(value: Column) -> Column:
        return F.transform(_listed(value), lambda t: normalise_target(F.coalesce(F.get_json_object(t, "$.target"), F.regexp_replace(t, r"^\[\[|\]\]$", ""))))

    pairs = F.array(*[F.struct(F.lit(k).alias("k"), targets(F.coalesce(fields[k], fields[k + "::"])).alias("v")) for k in RELATIONS])
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["v"]) > 0))


def heading_id(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), r"^-+|-+$", "")


def headings(content: Column) -> Column:
    """array<struct<level, text, id, line_number>>, lines from 1."""
    numbered = F.transform(F.split(content, "\n"), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("n")))
    found = F.filter(numbered, lambda x: x["line"].rlike(HEADING))
    text = lambda x: F.trim(F.regexp_extract(x["line"], HEADING, 2))
    return F.transform(found, lambda x: F.struct(F.length(F.regexp_extract(x["line"], HEADING, 1)).alias("level"), text(x).alias("text"), heading_id(text(x)).alias("id"), x["n"].alias("line_number")))


def block_references(content: Column) -> Column:
    numbered = F.transform(F.split(content, "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), (i + 1).alias("n")))
    found = F.filter(numbered, lambda x: x["line"].rlike(BLOCK_REFERENCE))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x["line"], BLOCK_REFERENCE, 1).alias("id"), x["n"].alias("line_number"), F.trim(F.regexp_replace(x["line"], BLOCK_REFERENCE, "")).alias("content")))


@F.pandas_udf(_rows(type=Y.StringType(), content=Y.StringType(), start_line=Y.IntegerType(), end_line=Y.IntegerType()))
def callouts(content: pd.Series) -> pd.Series:
    """`> [!type] head` and the quoted lines after it."""

    def one(text: str | None) -> list[dict]:
        out, lines = [], (text or "").split("\n")
        open_ = None
        for n, line in enumerate(lines, 1):
            m = re.match(CALLOUT, line)
            if m:
                open_ = {"type": m[1].lower(), "content": m[2].strip(), "start_line": n, "end_line": n}
                out.append(open_)
            elif open_ is not None and line.lstrip().startswith(">"):
                more = line.lstrip()[1:].strip()
                open_["content"] += ("\n" if open_["content"] else "") + more
                open_["end_line"] = n
            else:
                open_ = None
        return out

    return content.map(one)


@F.pandas_udf(_rows(full_match=Y.StringType(), start=Y.IntegerType(), end=Y.IntegerType(), line_number=Y.IntegerType()))
def link_positions(content: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[dict]:
        return [{"full_match": m[0], "start": m.start(), "end": m.end(), "line_number": text.count("\n", 0, m.start()) + 1} for m in re.finditer(WIKILINK, text or "")]

    return content.map(one)


# Where a chunk may end, best first.
BREAKS = [". ", ".\n", "? ", "! ", "\n\n", "\n"]


def chunk_spans(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    spans, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = next((p + len(b) for b in BREAKS if (p := text.rfind(b, start + least, end)) > start), 0) or text.rfind(" ", start + least, end)
            end = cut if cut > start else end
        if len(text[start:end].strip()) >= least or not spans:
            spans.append((start, end))
        if end == len(text):
            break
        start = max(start + 1, end - overlap)
    return spans


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, least: int = 50) -> DataFrame:
    """Rows (id, chunk_index, start_pos, end_pos, length, text) of overlapping chunks that end at sentences where they can."""

    @F.arrow_udf("array<struct<start_pos int, end_pos int>>")
    def spans(content: pa.Array) -> pa.Array:
        """One text at a time is a Python string; spans are held as numbers."""
        ends, flat = [0], array("i")
        for text in content:
            for a, b in chunk_spans(text.as_py() or "", size, overlap, least):
                flat.extend((a, b))
            ends.append(len(flat) // 2)
        both = np.frombuffer(flat, np.int32).reshape(-1, 2)
        columns = [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["start_pos", "end_pos"]))

    out = df.select(F.col(id_col), F.col(text_col).alias("_t"), F.posexplode(spans(F.col(text_col))).alias("chunk_index", "_s"))
    return out.select(id_col, "chunk_index", "_s.*", (F.col("_s.end_pos") - F.col("_s.start_pos")).alias("length"), F.col("_t").substr(F.col("_s.start_pos") + 1, F.col("_s.end_pos") - F.col("_s.start_pos")).alias("text"))


def resolve_link(source: Column, target: Column) -> Column:
    """The path a link with a folder in it means: without `#...`, from the source's folder, `.` and `..` followed; null if it leaves the root.

    A leading / means the root. Bare names are looked up among the files instead (see operators.links).
    """
    plain = F.regexp_replace(target, "#.*$", "")
    whole = F.when(plain.startswith("/"), F.substring(plain, F.lit(2), F.length(plain))).otherwise(F.concat_ws("/", F.regexp_extract(source, "^(.*)/[^/]*$", 1), plain))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    start = F.array().cast("array<string>")
    walk = F.aggregate(parts, start, lambda a, x: F.when(a.isNull() | ((x == "..") & (F.size(a) == 0)), F.lit(None).cast("array<string>")).when(x == "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    return F.array_join(walk, "/")


def parsed(notes: DataFrame) -> DataFrame:
    """Adds every part of a parsed note to rows with a content column."""
    c = F.col("content")
    out = notes.withColumn("frontmatter", frontmatter(c)).withColumn("body", body(c))
    f, b = F.col("frontmatter"), F.col("body")
    return out.withColumns({
        "tags": tags(c, f), "links": wikilinks(b), "headings": headings(b), "callouts": callouts(b), "block_references": block_references(b),
        "relationships": relationships(f), "word_count": F.size(F.filter(F.split(b, r"\s+"), lambda w: w != "")), "character_count": F.length(b),
    })
