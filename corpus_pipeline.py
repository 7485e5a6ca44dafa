"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of `documents`, with n_chars of
the text as it is then. Columns beside doc_id, text and n_chars stay as they
are, whatever their names; rows with a null doc_id are compared with nothing;
empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import lines, minhash, packing, quality, suffixes
from marginalia.llm.bpe import vocabulary
from marginalia.session import discard, keep, scratch, table, unused

#: Words of a shingle and least similarity in percent of near duplicates, the setting for stages on word shingles.
SHINGLE, SIMILAR = 5, 80


def _without_emptied(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """change(docs) without the rows that had words and lost all of them to earlier documents, n_chars brought up to date."""
    had, words = unused(docs, "had_words"), F.col("text").rlike(r"[^\s]")
    out = change(docs.withColumn(had, F.coalesce(words, F.lit(False)))).where(~F.col(had) | words).drop(had)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be good go.

    Null and empty texts have one score and stay or go together; equal rows
    too. Without labels all scores are 0.5 and every document goes.
    """
    net, score = quality.learn(docs, table(spark, sf_dir, "labels")), unused(docs, "quality_score")
    return quality.score_documents(docs, net, score_col=score).where(F.col(score) >= quality.GOOD).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go from the later one.

    Null and empty texts stay as they are; equal rows with one id are one
    document and keep a row each; a text that loses all its words goes.
    """
    return _without_emptied(docs, lines.dedup_lines)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id.

    Null and empty texts and null ids are like nothing and stay; equal rows
    with one id stay or go together.
    """
    gone = unused(docs, "gone_id")
    found = minhash.near_duplicates(docs, SHINGLE, SIMILAR).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found.hint("merge"), docs["doc_id"].cast("long") == found[gone], "left_anti")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document holds go.

    Null and short texts stay as they are; equal rows with one id are one
    document and keep a row each; a text that loses all its words goes.
    """
    return _without_emptied(docs, suffixes.remove_repeats)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces packed into sequences; every row is packed, null texts as empty ones."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("suffixes", suffix_stage), ("packing", pack_stage)]
#: Tokens, signatures and a trained network are beyond SQL; tests/llm holds each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what the stage wrote on its way goes with it, and so does its input
            after = keep(stage(spark, docs, sf_dir), f"stage-{name}", hold=True)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
