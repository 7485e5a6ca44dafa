"""Content features from words and runs cut once, against the counts over the text."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import notes as N
from marginalia.plans.catalog import QUERIES


def test_content_features_equal_their_own_counts_on_odd_texts_with_few_patterns(spark):
    texts = ["İdea FrameworK Kind framework FRAMEWORK", "_a a_ a_b __ ___ x__y_", "HTTPServer ABc AB A techTech bigData_tech algoRithm Algorithms", "good good good. GOOD bad\x0bbad", "# a\n \t## b\r\n- x\n12. y\n```\n```c\n # no\n", "", None, "ΣΑΣ. ΣΑΣ idea, idea", "9a a9 é é analysis ANALYSIS"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    made = N.content_features(df)
    c = F.col("content")
    want = {"total_words": T.word_count(c), "sentiment_score": T.sentiment(c), "avg_word_length": T.avg_word_length(c), "vocabulary_richness": T.vocabulary_richness(c), "technical_density": T.technical_density(c), "concept_density": T.concept_density(c), "content_type": T.content_type(c), **T.structure_counts(c)}
    assert {r["id"]: tuple(r)[1:] for r in made.select("id", *want).collect()} == {r["id"]: tuple(r)[1:] for r in df.select("id", *want.values()).collect()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count(") + plan.count("regexp_extract_all(") <= 3


def test_content_similarity_makes_features_once(spark, sf_dir):
    plan = QUERIES["m10_content_similarity"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
