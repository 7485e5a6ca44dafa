"""Score formulas of search, fusion and note quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases of keyword scores and domain indicators.
MATCH_BASE = {"exact": 0.9, "filename": 0.8, "name": 0.7, "content": 0.6, "fuzzy": 0.5, "children": 0.4}
DOMAINS = {
    "project": ["projects", "project"],
    "research": ["research", "studies", "papers"],
    "technical": ["code", "tech", "development", "programming"],
    "personal": ["journal", "personal", "diary"],
    "reference": ["reference", "resources", "docs"],
    "meeting": ["meetings", "notes"],
    "learning": ["learning", "courses", "education"],
}
DOMAIN_WORDS = {"technical": ["code", "function", "class", "algorithm"], "research": ["research", "study", "hypothesis"], "meeting": ["meeting", "agenda", "action items"]}


def tiers(value: Column, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """The value of the first step (least, value) that is reached."""
    out = F.when(value >= steps[0][0], F.lit(steps[0][1]))
    for least, v in steps[1:]:
        out = out.when(value >= least, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def normalised_semantic(score: Column) -> Column:
    return F.when(score >= 0, F.greatest(F.lit(0.0), 1.0 - score)).otherwise(F.exp(score / 5.0))


def keyword_score(match_type: Column, path: Column, query: str) -> Column:
    base = F.lit(0.5)
    for name, value in MATCH_BASE.items():
        base = F.when(match_type == name, F.lit(value)).otherwise(base)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    low = query.lower()
    return F.least(F.lit(1.0), base + F.when(F.lower(stem).contains(low), 0.1).otherwise(0.0) + F.when(F.lower(path).contains(low), 0.2).otherwise(0.0))


def unified(semantic: Column, keyword: Column) -> Column:
    return (
        F.when(semantic.isNotNull() & keyword.isNotNull(), 0.6 * semantic + 0.4 * keyword)
        .when(semantic.isNotNull(), 0.9 * semantic).when(keyword.isNotNull(), 0.8 * keyword).otherwise(0.0)
    )


def freshness(age_days: Column) -> Column:
    out = F.when(age_days.isNull(), 0.5)
    for most, value in ((7, 1.0), (30, 0.8), (90, 0.6), (365, 0.4), (730, 0.2)):
        out = out.when(age_days <= most, value)
    return out.otherwise(0.1)


def completeness(m: dict[str, Column]) -> Column:
    return F.least(
        F.lit(1.0),
        tiers(m["words"], [(500, 0.4), (200, 0.3), (100, 0.2), (50, 0.1)]) + tiers(m["headers"], [(3, 0.15), (1, 0.1)]) + tiers(m["lists"], [(3, 0.1), (1, 0.05)])
        + tiers(m["paragraphs"], [(3, 0.05)]) + tiers(m["paragraph_length"], [(50, 0.15), (25, 0.1), (15, 0.05)])
        + tiers(m["code"], [(1, 0.05)]) + tiers(m["tags"], [(2, 0.05)]) + tiers(m["reading"], [(3, 0.05)]),
    )


def structure(m: dict[str, Column]) -> Column:
    length = m["paragraph_length"]
    return F.least(
        F.lit(1.0),
        tiers(m["headers"], [(5, 0.4), (3, 0.3), (1, 0.2)]) + tiers(m["levels"], [(2, 0.1)]) + tiers(m["lists"], [(5, 0.2), (2, 0.15), (1, 0.1)])
        + tiers(m["paragraphs"], [(3, 0.1)]) + F.when(length.between(20, 100), 0.1).when(length.between(10, 150), 0.05).otherwise(0.0)
        + tiers(m["tags"], [(3, 0.1), (1, 0.05)]) + tiers(m["todos"], [(1, 0.1)]),
    )


def connections(outbound: Column, inbound: Column, mutual: Column, density: Column, broken: Column) -> Column:
    score = tiers(outbound, [(10, 0.4), (5, 0.3), (2, 0.2), (1, 0.1)]) + tiers(inbound, [(5, 0.3), (2, 0.2), (1, 0.1)]) + tiers(mutual, [(3, 0.2), (1, 0.1)]) + density * 0.1
    return F.least(F.lit(1.0), F.when(broken > 0, F.greatest(F.lit(0.0), score - F.least(F.lit(0.2), broken * 0.05))).otherwise(score))


def overall(complete: Column, structured: Column, connected: Column, fresh: Column) -> Column:
    """Weights 0.4, 0.3, 0.3 and 0.2, normalised."""
    return F.least(F.lit(1.0), (0.4 * complete + 0.3 * structured + 0.3 * connected + 0.2 * fresh) / 1.2)


def quality_level(score: Column) -> Column:
    return F.when(score <= 0.25, "seedling").when(score <= 0.5, "growing").when(score <= 0.75, "mature").otherwise("comprehensive")


def domain(path: Column, content: Column) -> Column:
    """By the path's parts first, then by words of the content; null if neither tells."""
    out = None
    low, text = F.lower(path), F.lower(content)
    for name, keys in DOMAINS.items():
        hit = low.rlike("|".join(keys))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, keys in DOMAIN_WORDS.items():
        out = out.when(text.rlike("|".join(keys)), name)
    return out


def combined_similarity(semantic: Column, tfidf: Column) -> Column:
    return clamp(0.7 * ((semantic + 1.0) / 2.0) + 0.3 * tfidf)


def day_difference(a: Column, b: Column) -> Column:
    """Whole days by the floor of the signed difference, so 12 hours are 1 one way and 0 the other."""
    return F.abs(F.floor((a.cast("double") - b.cast("double")) / 86400.0)).cast("long")


def word_count_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)
