"""Tables of a node or an edge a row do not go through the driver in rounds of local moving."""

from pyspark.sql import functions as F

from marginalia.operators import graph


def test_rounds_of_moving_broadcast_nothing_that_grows(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(200)).alias("dst"))
    both = graph.undirected(edges).withColumn("w", F.lit(1.0))
    labels = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("community", F.col("id"))
    new = graph.moved_labels(both, labels, 400.0, 0)
    assert new.count() == 200
    assert "BroadcastExchange" not in new._jdf.queryExecution().executedPlan().toString()
