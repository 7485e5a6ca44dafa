"""Text features as column expressions.

Java's \\w and \\b know ASCII only unless a pattern begins with (?U); patterns
here say (?U) where words of any language count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and constants that results depend on.
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "like", "enjoy", "happy", "pleased", "satisfied", "success", "achieve", "accomplish", "improve", "better", "best"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "hate", "dislike", "sad", "angry", "frustrated", "disappointed", "fail", "failure", "problem", "issue", "difficult", "hard", "struggle", "worst"]
TECHNICAL_PATTERNS = [r"\b[A-Z][a-z]*(?:[A-Z][a-z]*)+\b", r"\b[A-Z]{2,}\b", r"\b\w+(?:_\w+)+\b", r"\b\w*[Tt]ech\w*\b", r"\b\w*[Aa]lgorithm\w*\b", r"\b\w*[Dd]ata\w*\b"]
CONCEPT_PATTERNS = [r"\b[A-Z][a-z]+\b", r"\b(?:concept|theory|principle|framework|model|approach)\b", r"\b(?:analysis|synthesis|evaluation|application)\b"]
CONTENT_TYPES = {
    "technical": ["algorithm", "function", "class", "method", "implementation", "code", "programming", "software", "system", "architecture"],
    "academic": ["research", "study", "analysis", "theory", "hypothesis", "methodology", "findings", "conclusion", "literature"],
    "business": ["strategy", "market", "customer", "revenue", "profit", "business", "management", "organization", "process"],
    "creative": ["design", "creative", "art", "visual", "aesthetic", "inspiration", "concept", "idea", "innovation"],
    "scientific": ["experiment", "hypothesis", "data", "results", "method", "observation", "measurement", "analysis", "conclusion"],
}


#: A word character of any language; Java's lookarounds on it stand for \b.
_W = r"[\p{L}\p{N}_]"
#: White space within a line.
_BLANK = r"[ \t\x0B\f\r]*"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text_of(c), r"\s+"), lambda w: w != "")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(text_of(c), F.lit(pattern))


def word_count(c: Column) -> Column:
    return count_of(c, r"\S+")


def regex_word_count(c: Column) -> Column:
    """Runs of letters, digits and underscores of any language."""
    return count_of(c, _W + "+")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def one_of(listed: list[str], edge: str) -> str:
    """A pattern of whole words, which neither follow nor precede a character of the class `edge`."""
    return f"(?<!{edge})(?:" + "|".join(listed) + f")(?!{edge})"


def sentiment_of(good: Column, bad: Column, n: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio((good - bad).cast("double"), n) * 10))


def sentiment(c: Column) -> Column:
    """Ten times (positive - negative) words over words, between -1 and 1."""
    low = F.lower(text_of(c))
    return sentiment_of(count_of(low, one_of(POSITIVE, r"\S")), count_of(low, one_of(NEGATIVE, r"\S")), word_count(c))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")


def sentence_count(c: Column) -> Column:
    """Runs between full stops, exclamation and question marks that are not blank."""
    return count_of(c, r"[^.!?\s][^.!?]*+")


def avg_sentence_length(c: Column) -> Column:
    return ratio(word_count(c).cast("double"), sentence_count(c))


def solid_length(c: Column) -> Column:
    """Code points that are no white space."""
    return F.length(text_of(c)) - count_of(c, r"\s")


def avg_word_length(c: Column) -> Column:
    """Mean code points of the runs between white space."""
    return ratio(solid_length(c).cast("double"), word_count(c))


def flesch(asl: Column, awl: Column) -> Column:
    return F.when(asl > 0, F.greatest(F.lit(0.0), 206.835 - 1.015 * asl - 84.6 * (awl / 4.7))).otherwise(0.0)


def grade_level(asl: Column, awl: Column) -> Column:
    return F.when(asl > 0, F.greatest(F.lit(0.0), 0.39 * asl + 11.8 * (awl / 4.7) - 15.59)).otherwise(0.0)


def plain_words(c: Column) -> Column:
    """Words of ASCII letters only, lower-cased."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(f"(?<!{_W})([a-z]++)(?!{_W})"), F.lit(1))


def richness_of(w: Column) -> Column:
    return ratio(F.size(F.array_distinct(w)).cast("double"), F.size(w))


def vocabulary_richness(c: Column) -> Column:
    return richness_of(plain_words(c))


#: The technical and concept patterns without backtracking over words: a word that holds a part is found from the part on.
_TECHNICAL = [f"(?<!{_W})[A-Z][a-z]*(?:[A-Z][a-z]*)+(?!{_W})", f"(?<!{_W})[A-Z]{{2,}}(?!{_W})", f"(?<!{_W}){_W}+?_{_W}++", f"[Tt]ech{_W}*+", f"[Aa]lgorithm{_W}*+", f"[Dd]ata{_W}*+"]
_CONCEPT = [f"(?i)(?<!{_W})[a-z]{{2,}}+(?!{_W})", "(?i)" + one_of(["concept", "theory", "principle", "framework", "model", "approach"], _W), "(?i)" + one_of(["analysis", "synthesis", "evaluation", "application"], _W)]
CONCEPT_WORDS = ["concept", "theory", "principle", "framework", "model", "approach", "analysis", "synthesis", "evaluation", "application"]


def matches(c: Column, patterns: list[str]) -> Column:
    return sum((count_of(c, p) for p in patterns[1:]), count_of(c, patterns[0]))


def density(found: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), ratio(found.cast("double"), n))


def technical_density(c: Column) -> Column:
    return density(matches(c, _TECHNICAL), word_count(c))


def concept_density(c: Column) -> Column:
    return density(matches(c, _CONCEPT), word_count(c))


def content_type(c: Column) -> Column:
    """The type with most indicator words, the first of equals, `general` without any."""
    low = F.lower(text_of(c))
    rows = [F.struct(count_of(low, one_of(ws, _W)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(CONTENT_TYPES.items())]
    return F.element_at(F.transform(F.array(F.array_max(F.array(*rows))), lambda top: F.when(top["n"] == 0, "general").otherwise(top["name"])), 1)


def complexity(readability: Column, technical: Column, concept: Column, richness: Column, asl: Column, total_words: Column) -> Column:
    """Mean of the factors that are known; entities are none without a model."""
    parts = F.filter(
        F.array(
            F.when(readability > 0, F.greatest(F.lit(0.0), (100 - readability) / 100)), technical, concept, richness,
            F.when(asl > 0, F.least(F.lit(1.0), asl / 25.0)), F.when(total_words > 0, F.lit(0.0)),
        ),
        lambda x: x.isNotNull(),
    )
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)


def structure_counts(c: Column) -> dict[str, Column]:
    """Headings (any line that begins with #), deepest heading, list items and pairs of code fences."""
    line = "(?md)^" + _BLANK
    depth = F.array_max(F.transform(F.regexp_extract_all(text_of(c), F.lit(line + "(#+)"), F.lit(1)), lambda h: F.length(h)))
    return {"heading_count": count_of(c, line + "#"), "max_heading_depth": F.coalesce(depth, F.lit(0)), "list_count": count_of(c, line + r"(?:[-*+]|\d+\.)"), "code_block_count": F.floor(count_of(c, line + "```") / 2).cast("int")}


def runs(c: Column) -> Column:
    """Runs of letters, digits and underscores of any language."""
    return F.regexp_extract_all(text_of(c), F.lit(f"({_W}+)"), F.lit(1))


def among(found: Column, listed: list[str]) -> Column:
    return F.filter(found, lambda w: w.isin(*listed))


def plain_of(found: Column) -> Column:
    """plain_words() from the runs of the lower-cased text."""
    return F.filter(found, lambda w: w.rlike("^[a-z]++$"))


def technical_of(found: Column) -> Column:
    """What matches() counts by the technical patterns, from the runs of the text: each of them finds a run once at most."""
    some = F.filter(found, lambda w: w.rlike("^[A-Z]|_|[Tt]ech|[Aa]lgorithm|[Dd]ata"))
    whole = ("^[A-Z][a-z]*(?:[A-Z][a-z]*)+$", "^[A-Z]{2,}$", "^.+?_.", "[Tt]ech", "[Aa]lgorithm", "[Dd]ata")
    return F.aggregate(some, F.lit(0), lambda n, w: n + sum((w.rlike(p).cast("int") for p in whole[1:]), w.rlike(whole[0]).cast("int")))


def letters_of(found: Column) -> Column:
    """Runs of two ASCII letters or more, lower-cased."""
    return F.transform(F.filter(found, lambda w: w.rlike("^[A-Za-z]{2,}+$")), F.lower)


def concept_of(letters: Column) -> Column:
    """What matches() counts by the concept patterns, from letters_of() the runs of the text."""
    return F.size(letters) + F.size(among(letters, CONCEPT_WORDS))


def typed_of(found: Column) -> Column:
    """Indicator words among the runs of the lower-cased text."""
    return among(found, sorted({w for ws in CONTENT_TYPES.values() for w in ws}))


def type_of(typed: Column) -> Column:
    """content_type() from typed_of()."""
    rows = [F.struct(F.size(among(typed, ws)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(CONTENT_TYPES.items())]
    return F.element_at(F.transform(F.array(F.array_max(F.array(*rows))), lambda top: F.when(top["n"] == 0, "general").otherwise(top["name"])), 1)


def marked_lines(c: Column) -> Column:
    """Lines that structure_counts() counts."""
    return F.filter(F.split(text_of(c), "\n"), lambda line: line.rlike("^" + _BLANK + r"(?:#|[-*+]|\d+\.|```)"))


def structure_of(lines: Column) -> dict[str, Column]:
    """structure_counts() from marked_lines()."""
    n = lambda pattern: F.size(F.filter(lines, lambda line: line.rlike("^" + _BLANK + pattern)))
    depth = F.array_max(F.transform(lines, lambda line: F.length(F.regexp_extract(line, "^" + _BLANK + "(#+)", 1))))
    return {"heading_count": n("#"), "max_heading_depth": F.coalesce(depth, F.lit(0)), "list_count": n(r"(?:[-*+]|\d+\.)"), "code_block_count": F.floor(n("```") / 2).cast("int")}


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(c), r"\s+", " "))


_ODD = r"(?U)[^\w\s.,!?;:\-'\"(){}\[\]]+"
_LINK = r"\[([^\]]+)\]\([^)]+\)"


def clean_for_encoder(c: Column) -> Column:
    out = F.regexp_replace(text_of(c), r"\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+", "[URL]"), _LINK, "$1")
    return F.trim(F.regexp_replace(out, _ODD, ""))


def clean_for_terms(c: Column) -> Column:
    out = F.regexp_replace(text_of(c), r"\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+", ""), _LINK, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?m)^#+\s*", ""), _ODD, " "))


def clean_markup(c: Column) -> Column:
    out = text_of(c)
    for pattern in (r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"`(.*?)`", _LINK):
        out = F.regexp_replace(out, pattern, "$1")
    return collapse(out)


def truncated(c: Column, most: int = 8000) -> Column:
    """At most `most` code points, cut after the last sentence if that keeps over four fifths."""
    head = F.substring(c, 1, most)
    last = F.lit(most) - F.instr(F.reverse(head), " .")  # from 0, where ". " begins, less one
    at = F.when(F.instr(head, ". ") > 0, last - 1)
    return F.when(F.length(c) <= most, c).when(at > 0.8 * most, F.substring(head, F.lit(1), (at + 1).cast("int"))).otherwise(head)


def summary(body: Column, most: int = 200) -> Column:
    """Plain text of Markdown without its front matter, cut at a word."""
    out = body
    for pattern, to in ((r"#+\s+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"\[\[(.*?)\]\]", "$1"), (_LINK, "$1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"`([^`]+)`", "$1"), (r"(?s)```.*?```", "")):
        out = F.regexp_replace(out, pattern, to)
    out = collapse(out)
    return F.when(F.length(out) > most, F.concat(F.regexp_replace(F.substring(out, 1, most), r"\s\S*$", ""), F.lit("..."))).otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def title_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b))))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_distance(a: Column, b: Column) -> Column:
    """Steps from one path up to the common part and down to the other, file names included."""
    x, y = path_parts(a), path_parts(b)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + (s["on"] & e).cast("int")).alias("n")))["n"]
    return F.size(x) + F.size(y) - 2 * common


def human_bytes(size: Column) -> Column:
    """A size with one decimal in the largest unit that it has one of: `512 B`, `1.5 KB`."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", size / float(1024**power)))
    return out.otherwise(F.format_string("%.1f TB", size / float(1024**4)))
