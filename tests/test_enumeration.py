"""Pairs by number: what goes round for them, and blocks smaller than the table."""

from pyspark.sql import functions as F

from marginalia.operators import pairs


def test_pairs_of_small_blocks_come_in_chunks_and_are_not_shuffled(spark):
    n = spark.range(23).select((F.col("id") * 7 % 23).alias("id"))
    every = [(i, j) for j in range(23) for i in range(j)]
    for first, most in ((0, None), (0, 40), (40, 100), (100, 53), (153, 500), (252, 1), (253, 5)):
        got = sorted(tuple(r) for r in pairs.enumerated(n, first, most, block=5).collect())
        assert got == sorted(every[first : None if most is None else first + most])
    assert pairs.enumerated(n.limit(0)).count() == 0
    made = pairs.enumerated(spark.range(3000))
    made.count()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # Pairs are made by the last step, above all joins.
    assert plan.index("Generate explode(slice(") < plan.index("Join")
