"""TF-IDF as tables: words and pairs of words, smooth idf, raw counts, documents of length one."""

from __future__ import annotations

import glob
import os
import re
import unicodedata
import zipfile
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"(?<!\w)[a-z][a-z0-9]*+(?!\w)")


@cache
def stop_words(language: str = "english") -> tuple[str, ...]:
    """The words that Spark's StopWordsRemover leaves out by default, read from its jar, so that no session is needed."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            text = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode()
        return tuple(sorted({w for w in text.split("\n") if w.isalpha()}))
    raise FileNotFoundError("no spark-mllib jar")


@cache
def accents() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they are made of, by Unicode's decompositions."""
    marked = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {k: v[0] for k, v in marked.items() if len(v) > 1 and v[0].isascii() and all(unicodedata.combining(x) for x in v[1:])}
    return "".join(plain), "".join(plain.values())


#: Latin letters that have marks.
_MARKED = re.compile("[\u00c0-\u024f\u1e00-\u1eff]")
#: Terms that a task counts before it gives the counts on.
PART = 1_000_000


def tokens(text: str | None) -> list[str]:
    """Lower-cased words of ASCII letters and digits that begin with a letter, once accents are off."""
    low = (text or "").lower()
    if not low.isascii():
        plain = _plain()
        low = _MARKED.sub(lambda m: plain.get(m[0], m[0]), low)
    return _WORD.findall(low)


@cache
def _plain() -> dict[str, str]:
    return dict(zip(*accents(), strict=True))


def grams(words: list[str], stop: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Words and pairs of neighbours, without stop words before pairs are made."""
    kept = [w for w in words if w not in stop] if stop else words
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)]


def documents(docs: DataFrame, id_col: str, text_col: str = "text", stop: tuple[str, ...] | None = None, pairs: bool = True, only: frozenset[str] | None = None) -> DataFrame:
    """id, terms: the words of each document and, if asked, the pairs of neighbours, of a vocabulary if one is given; null text has none."""
    out = frozenset(stop_words() if stop is None else stop)

    def of(text: str | None) -> list[str]:
        found = grams(tokens(text), out) if pairs else [w for w in tokens(text) if w not in out]
        return found if only is None else [t for t in found if t in only]

    @F.arrow_udf("array<string>")
    def found(text: pa.Array) -> pa.Array:
        return pa.array((of(t.as_py()) for t in text), pa.list_(pa.string()))

    made = docs.select(F.col(id_col).alias("id"), found(F.col(text_col)).alias("terms"))
    made.made_of = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of)
    return made


def _read(docs: DataFrame) -> tuple[DataFrame, Callable]:
    """(rows of id and text, or of id and terms; what makes the terms): those of documents() are made where they are counted."""
    return getattr(docs, "made_of", None) or (docs.select("id", "terms"), lambda terms: terms or [])


def _counts(batches: Iterator[pa.RecordBatch], of: Callable) -> Iterator[pa.RecordBatch]:
    """term, d (documents), n (places) of the rows (text), for about PART terms at a time."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([once[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "d", "n"])

    once, total, seen = Counter(), Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            terms = of(text.as_py())
            total.update(terms)
            once.update(set(terms))
            seen += len(terms)
            if seen >= PART:
                yield out()
                once, total, seen = Counter(), Counter(), 0
    if total:
        yield out()


def vocabulary(docs: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.8, max_features: int | None = 1000) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1 of (id, terms); the commonest terms stay, ties by term.

    Tasks count both, documents and places, for parts of their rows, and what
    goes round is a row for each different term of a part.
    """
    rows, of = _read(docs)
    df = rows.select(rows.columns[1]).mapInArrow(lambda batches: _counts(batches, of), "term string, d long, n long").groupBy("term").agg(F.sum("d").alias("df"), F.sum("n").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        df = df.orderBy(F.col("total").desc(), "term").limit(max_features)
    return df.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(docs: DataFrame, vocab: DataFrame, most: int | None = 1000) -> DataFrame:
    """id, term, weight of (id, terms), with each document's weights scaled to length one.

    A vocabulary of at most `most` terms goes to all tasks, which thin the terms
    and count them by document; a document's counts meet as one row for each
    row of it. None stands for a vocabulary without a bound, which is joined.
    """
    known = vocab.select("term", "idf")
    if most is None:
        tf = docs.select("id", F.explode("terms").alias("term")).join(known, "term").groupBy("id", "term").agg((F.count("*") * F.first("idf")).alias("w"))
    else:
        rows = known.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} terms: give most as None")
        code_of = {r["term"]: k for k, r in enumerate(rows)}
        read, of = _read(docs)

        def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends, codes, n = [0], array("i"), array("q")
                for text in batch.column(1):
                    found = Counter(filter(code_of.__contains__, of(text.as_py())))
                    codes.extend(code_of[t] for t in found)
                    n.extend(found.values())
                    ends.append(len(codes))
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(x, kind))) for x, kind in ((codes, np.int32), (n, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "code", "n"])

        kind = docs.select("id").schema["id"].dataType.simpleString()
        counted = read.mapInArrow(thinned, f"id {kind}, code array<int>, n array<bigint>").where(F.size("code") > 0).repartition("id")
        each = counted.select("id", F.explode(F.arrays_zip("code", "n")).alias("x")).groupBy("id", "x.code").agg(F.sum("x.n").alias("n"))
        terms_, idfs = F.array(*[F.lit(r["term"]) for r in rows]), F.array(*[F.lit(r["idf"]) for r in rows])
        if not rows:
            return docs.limit(0).select("id", F.lit("").alias("term"), F.lit(0.0).alias("weight"))
        tf = each.select("id", F.get(terms_, F.col("code")).alias("term"), (F.col("n") * F.get(idfs, F.col("code"))).alias("w"))
    length = Window.partitionBy("id")
    return tf.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(length))).alias("weight"))


def top_terms(w: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.round("weight", 9).desc(), "term")
    return w.where("weight > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_cosine(w: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, tfidf_similarity of the given pairs, 0 without a common term."""
    a, b = w.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa")), w.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    met = pairs.select("a", "b").join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return pairs.select("a", "b").join(met, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0.0)).alias("tfidf_similarity"))
