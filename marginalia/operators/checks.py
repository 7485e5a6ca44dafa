"""Checks of vaults and of the tables made from them, as rows and as findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import pairs as P

#: Notes that a folder or vault must have, notes that a sample looks at, bytes from which a note is large.
LEAST_NOTES, SAMPLE, LARGE = 5, 20, 1 << 20


def enough(df: DataFrame, least: int, what: str) -> int:
    """The number of rows; fewer than asked for are an error."""
    n = df.limit(least).count() if least > 0 else 0
    if n < least:
        raise ValueError(f"{what}: {n} rows, {least} are needed")
    return df.count()


def top_folders(notes: DataFrame) -> DataFrame:
    """folder, notes, size and subfolders of each top folder; notes beside the folders are under the empty name."""
    parts = T.path_parts(F.col("path"))
    n = notes.select(F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("folder"), F.when(F.size(parts) > 2, parts[1]).alias("sub"), "size")
    return n.groupBy("folder").agg(F.count("*").alias("notes"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count_distinct("sub").alias("subfolders"))


def areas(notes: DataFrame, name: str = "Areas", least: int = LEAST_NOTES) -> DataFrame:
    """One row about the folder that datasets are confined to: exists, notes, subfolders, size, valid, excluded (other top folders, sorted) and the share of notes that is left out."""
    f = top_folders(notes)
    own = F.col("folder") == name
    out = f.agg(
        F.coalesce(F.max(own), F.lit(False)).alias("exists"), F.coalesce(F.sum(F.when(own, F.col("notes"))), F.lit(0)).alias("notes"), F.coalesce(F.max(F.when(own, F.col("subfolders"))), F.lit(0)).alias("subfolders"),
        F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).alias("size"), F.array_sort(F.collect_list(F.when(~own & (F.col("folder") != ""), F.col("folder")))).alias("excluded"), F.coalesce(F.sum("notes"), F.lit(0)).alias("total"),
    )
    left = F.col("total") - F.col("notes")
    return out.withColumns({"valid": F.col("exists") & (F.col("notes") >= least), "excluded_notes": left, "privacy_percentage": T.ratio(100.0 * left, F.col("total"))})


def areas_status(notes: DataFrame, name: str | None, least: int = LEAST_NOTES) -> dict:
    """What confinement to a folder does to a vault, in words and numbers; without a name nothing is left out."""
    if name is None:
        return {"filtering": False, "protection": "none", "summary": "all content is included", "excluded": []}
    r = areas(notes, name, least).first()
    shown = ", ".join(r["excluded"][:3]) + (", ..." if len(r["excluded"]) > 3 else "")
    summary = f"{len(r['excluded'])} folders left out ({shown})" if r["excluded"] else f"{name} only, there are no other folders"
    return {"filtering": True, "protection": "high" if r["excluded"] else "medium", "summary": summary, "excluded": r["excluded"], "notes": r["notes"], "valid": r["valid"], "privacy_percentage": r["privacy_percentage"]}


def content_sample(notes: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Ratios over the first notes by path: with content (over 50 characters), with links, with front matter, and mean words of those with content."""
    c = T.text_of(F.col("content"))
    first = notes.orderBy("path").limit(sample)
    solid = F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) > 50
    linked = F.contains(c, F.lit("[[")) | F.contains(c, F.lit("]("))
    of = lambda x: F.coalesce(F.avg(x.cast("double")), F.lit(0.0))
    return first.agg(F.count("*").alias("sampled"), of(solid).alias("content_ratio"), of(linked).alias("link_ratio"), of(c.rlike(r"(?s)^---\s*\n.*?\n---\s*\n")).alias("metadata_ratio"), F.coalesce(F.avg(F.when(solid, T.word_count(c))), F.lit(0.0)).alias("avg_words"))


def sample_findings(ratios: dict) -> list[str]:
    limits = [("content_ratio", 0.5, "many notes have little content"), ("link_ratio", 0.2, "few notes have links"), ("metadata_ratio", 0.3, "few notes have front matter"), ("avg_words", 50, "notes are short on average")]
    return [text for name, least, text in limits if ratios[name] < least]


def vault(notes: DataFrame, confined_to: str | None = None, least: int = LEAST_NOTES) -> dict:
    """Errors and warnings about a vault: its notes, empty and large ones, the folder it is confined to, and a sample of its content."""
    errors, warnings = [], []
    if confined_to is not None:
        a = areas(notes, confined_to, least).first()
        if not a["exists"]:
            errors.append(f"there is no folder {confined_to}")
        elif not a["valid"]:
            errors.append(f"{confined_to} has {a['notes']} notes, {least} are needed")
        elif a["excluded_notes"]:
            warnings.append(f"{a['excluded_notes']} notes are left out")
        notes = notes.where(F.col("path").startswith(confined_to + "/"))
    r = notes.agg(F.count("*").alias("n"), F.sum((F.col("size") == 0).cast("long")).alias("empty"), F.sum((F.col("size") > LARGE).cast("long")).alias("large")).first()
    if not r["n"]:
        errors.append("there are no notes")
    else:
        warnings += [f"only {r['n']} notes"] * (r["n"] < least) + ["many notes are empty"] * (r["empty"] > 0.5 * r["n"]) + [f"{r['large']} notes are large"] * bool(r["large"])
        warnings += sample_findings(content_sample(notes).first().asDict())
    return {"valid": not errors, "errors": errors, "warnings": warnings, "notes": r["n"]}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, nulls, mean, sd, low, high of numeric columns, in one pass."""
    each = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.avg(c).alias("mean"), F.stddev(c).alias("sd"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
    return df.agg(F.array(*[each(c) for c in columns]).alias("s")).select(F.inline("s"))


def value_counts(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(most)


def recommendations(valid: bool, warnings: list[str], avg_words: float | None = None, positive_ratio: float | None = None) -> list[str]:
    """What to do about a pair of datasets."""
    rules = [
        (not valid, "mend what is invalid before training"), (avg_words is not None and avg_words < 50, "leave out notes under 50 words"), (positive_ratio is not None and positive_ratio < 0.1, "raise the share of linked pairs"),
        (positive_ratio is not None and positive_ratio > 0.5, "add pairs that are not linked"), (bool(warnings), "look at the warnings"),
    ]
    return [text for on, text in rules if on]


def quality_report(notes: DataFrame, pairs: DataFrame, counts: list[str]) -> dict:
    """Findings, statistics and recommendations about a note table and a pair table."""
    found = P.check_notes(notes, counts) + P.check_pairs(pairs)
    same = P.consistency(pairs, notes)
    ratio = pairs.agg(F.avg(F.col("link_exists").cast("double"))).first()[0] or 0.0
    words = notes.agg(F.avg("word_count")).first()[0] if "word_count" in notes.columns else None
    numeric = [c for c, t in notes.dtypes if t in ("int", "bigint", "double", "float")]
    return {"valid": same["valid"] and not any(f.startswith("no ") for f in found), "findings": found, "consistency": same, "notes": describe(notes, numeric), "positive_ratio": ratio, "recommendations": recommendations(same["valid"], found, words, ratio)}


def missing_features(df: DataFrame, required: list[str]) -> list[str]:
    """Findings about the columns that every row must have: missing, null, NaN or beyond 1e10."""
    out = [f"{c} is missing" for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    numbers = [c for c, t in df.dtypes if c in have and t in ("double", "float")]
    tests = [*[(F.col(c).isNull(), f"{c} is null") for c in have], *[(F.isnan(c), f"{c} is not a number") for c in numbers], *[((F.abs(c) > 1e10) & ~F.isnan(c), f"{c} is extreme") for c in numbers]]
    if not tests:
        return out
    r = df.agg(*[F.sum(F.coalesce(t, F.lit(False)).cast("long")).alias(f"t{k}") for k, (t, _) in enumerate(tests)]).first()
    return out + [text for k, (_, text) in enumerate(tests) if r[f"t{k}"]]
