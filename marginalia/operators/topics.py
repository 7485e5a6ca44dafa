"""Topic models over weighted terms of documents: LDA by variational inference, or KMeans."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.terms import documents, vocabulary
from marginalia.session import unused


def _terms(docs: DataFrame, text_col: str, only: list[str] | None = None) -> DataFrame:
    """Adds the words of each document and pairs of neighbours, without stop words, of a vocabulary if one is given."""
    key = unused(docs, "row")
    whole = docs.withColumn(key, F.struct(*docs.columns))
    found = documents(whole, key, text_col, only=None if only is None else frozenset(only))
    return found.select("id.*", F.col("terms").alias("tokens"))


def fit(docs: DataFrame, text_col: str = "text", topics: int | None = None, method: str = "lda", max_features: int = 1000, min_df: float = 2.0, max_df: float = 0.8, seed: int = 42, rounds: int = 100, starts: int = 10) -> PipelineModel:
    """A fitted pipeline; the number of topics follows the number of documents unless it is given.

    Terms weigh their count times ln((1 + n) / (1 + df)) + 1, scaled to length
    one per document. LDA goes through all documents in each round of
    variational inference. KMeans runs from several starts, of which the one
    with the least cost stays; its first tie is the earlier seed.
    """
    if method not in ("lda", "kmeans"):
        raise ValueError("method is lda or kmeans")
    n = docs.count()
    k = topics or (min(10, max(2, n // 10)) if method == "lda" else min(8, max(2, n // 15)))
    share = max_df if max_df < 1 and max_df * n >= min_df else 1.0
    own = unused(docs, "row")
    # At most max_features rows, the commonest first.
    known = vocabulary(documents(docs.withColumn(own, F.lit(0)), own, text_col), n, min(min_df, n), share, max_features).collect()
    vocab = [r["term"] for r in known]
    count = CountVectorizerModel.from_vocabulary(vocab, inputCol="tokens", outputCol="counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in known]), inputCol="counts", outputCol="scaled")
    unit = Normalizer(p=2.0, inputCol="scaled", outputCol="features")
    rows = unit.transform(scale.transform(count.transform(_terms(docs.select(text_col), text_col, vocab)))).select("features").cache()
    try:
        if method == "lda":
            model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=1.0, topicDistributionCol="topics").fit(rows)
        else:
            tried = [KMeans(k=k, seed=seed + s, maxIter=rounds, predictionCol="topic").fit(rows) for s in range(starts)]
            model = min(tried, key=lambda m: m.summary.trainingCost)
        return PipelineModel([count, scale, unit, model])
    finally:
        rows.unpersist()


def predict(model: PipelineModel, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds topic_probabilities, dominant_topic and its probability."""
    out = model.transform(_terms(docs, text_col, model.stages[0].vocabulary))
    if "topics" in out.columns:
        out = out.withColumn("topic_probabilities", vector_to_array("topics"))
    else:
        k = len(model.stages[-1].clusterCenters())
        out = out.withColumn("topic_probabilities", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("topic")).cast("double")))
    best = F.array_max("topic_probabilities")
    out = out.withColumn("dominant_topic", F.array_position("topic_probabilities", best).cast("int") - 1).withColumn("dominant_topic_probability", best)
    return out.drop("tokens", "counts", "scaled", "features", "topics", "topic")


def topic_words(model: PipelineModel, words: int = 5) -> list[dict]:
    """The heaviest words of each topic and their weights, for export as JSON: topics times words, whatever the number of documents."""
    vocab, last = model.stages[0].vocabulary, model.stages[-1]
    if hasattr(last, "describeTopics"):
        return [{"topic": r["topic"], "words": [vocab[i] for i in r["termIndices"]], "weights": list(r["termWeights"])} for r in last.describeTopics(words).collect()]
    out = []
    for k, c in enumerate(last.clusterCenters()):
        first = sorted(range(len(c)), key=lambda i: (-c[i], vocab[i]))[:words]
        out.append({"topic": k, "words": [vocab[i] for i in first], "weights": [float(c[i]) for i in first]})
    return out


def topic_sizes(predicted: DataFrame) -> DataFrame:
    """dominant_topic, documents and the mean probability of the topic among them."""
    return predicted.groupBy("dominant_topic").agg(F.count("*").alias("documents"), F.avg("dominant_topic_probability").alias("probability"))
