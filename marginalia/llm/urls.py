"""URL filters: longest-rule verdicts, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import table

#: (verdict, host, path) of the production rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The labelled URL table that the model learns from when no other is given.
LABELLED = [
    *((u, "allow") for u in [
        "https://www.university-library.example/catalogue/history", "https://docs.project.example/en/guide/install", "http://museum.example/collections/painting", "https://news.city.example/2023/05/council-meeting", "https://en.encyclopedia.example/wiki/Astronomy",
        "https://blog.gardener.example/posts/pruning-roses", "https://www.school.example/lessons/algebra", "http://journal.science.example/articles/volume-12", "https://recipes.kitchen.example/bread/sourdough", "https://forum.cyclists.example/threads/repair",
        "https://www.hospital.example/patients/information", "http://archive.parliament.example/debates/1998", "https://m.weather.example/forecast/north", "https://www.bookshop.example/reviews/novels", "https://research.institute.example/papers/climate",
        "https://travel.notes.example/fr/alps", "https://www.theatre.example/programme/autumn", "http://open.data.example/tables/transport", "https://blog.teacher.example/en/reading", "https://www.court.example/decisions/2019",
    ]),
    *((u, "block") for u in [
        "http://casino-bonus-777.example/free-spins?aff=9", "https://cheap-pills-online.example/buy-now", "http://spam-farm.example/en/1?ref=x", "https://www.spam-farm.example/links/page2", "http://win-prize-click.example/claim/now", "https://adult-xxx-cams.example/live",
        "http://free-download-crack.example/keygen.exe", "https://best-loans-fast.example/apply?utm_source=spam", "http://seo-links-cheap.example/backlinks", "https://porn-tube-hot.example/video/123", "http://replica-watches.example/sale", "https://poker-slots-bet.example/jackpot",
        "http://hot-singles.example/join?aff=12", "https://click-track-redirect.example/r?u=1", "http://warez-torrent.example/download/movie", "https://miracle-diet-pills.example/offer", "http://crypto-doubler.example/invest/now", "https://spam-blog-farm.example/tag/cheap",
        "http://fake-bags-outlet.example/buy", "https://instant-cash-win.example/bonus",
    ]),
]
#: Hashed features and the lengths of the n-grams.
BITS, GRAMS = 14, (3, 4, 5)


def split_url(url):
    """Columns (host, path): host from after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; path from there to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host, path, rules):
    """(rule text, verdict) of the longest rule that fits, else nulls; of equally long ones the last in order of text."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def features(urls: list[str]) -> list[np.ndarray]:
    """Distinct buckets of the character n-grams of each `host path` text."""
    out = []
    for u in urls:
        raw = np.frombuffer(("\x02" + u + "\x03").encode(), np.uint8).astype(np.uint64)
        found = []
        for n in GRAMS:
            if len(raw) >= n:
                h = np.full(len(raw) - n + 1, 1469598103934665603 + n, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(n):
                        h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(1099511628211)
                found.append(h >> np.uint64(64 - BITS))
        out.append(np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64))
    return out


def train(labelled: list[tuple[str, str]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression for `block`, by full gradient steps on the small table.

    labelled holds ("host path", verdict). Features count 1 / sqrt(n) for n of them.
    """
    rows, y = features([u for u, _ in labelled]), np.asarray([v == "block" for _, v in labelled], float)
    w, bias = np.zeros(1 << BITS), 0.0
    scale = [1 / np.sqrt(max(1, len(r))) for r in rows]
    for _ in range(rounds if len(rows) else 0):
        p = np.asarray([1 / (1 + np.exp(-(bias + s * w[r].sum()))) for r, s in zip(rows, scale, strict=True)])
        g = (p - y) / len(y)
        w *= 1 - rate * decay
        for r, s, e in zip(rows, scale, g, strict=True):
            w[r] -= rate * len(y) ** 0.5 * e * s
        bias -= rate * g.sum()
    return w, bias


def plain_split(url: str) -> str:
    """split_url() of one string of the labelled table, as `host path`."""
    rest = url.partition("://")[2]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return host.translate({c: c + 32 for c in range(65, 91)}) + " " + path


def judge_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of `block`) for every row.

    A null url, or one without `://`, has an empty host and path, fits no rule
    and is judged by the model's bias. Rules are columns of `when`, so they stay
    in the JVM; only the model's score runs in Python. Repeated rows are
    independent, very long urls are read whole, an empty table gives an empty
    table, and further columns, whatever their names, are not read.
    """
    w, bias = train([(plain_split(u), v) for u, v in labelled])

    @F.pandas_udf("double")
    def score(host_path: pd.Series) -> pd.Series:
        rows = features(host_path.tolist())
        return pd.Series([1 / (1 + np.exp(-(bias + w[r].sum() / np.sqrt(max(1, len(r)))))) for r in rows], dtype="float64")

    host, path = split_url(F.col("url"))
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", name).withColumn("_verdict", verdict).withColumn("score", score(F.concat_ws(" ", "host", "path")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
