"""Numbers of rows follow the order of their keys at any size."""

from pyspark.sql import functions as F

from marginalia.operators import pairs


def test_numbers_in_key_order(spark):
    d = spark.range(1000).select(F.col("id") * 7 % 1000, (F.col("id") % 3).alias("group")).toDF("id", "group")
    got = sorted((r["id"], r["n"], r["total"]) for r in pairs.numbered(d, "id", rows=100).collect())
    assert got == [(k, k, 1000) for k in range(1000)]
    inside = {}
    for r in pairs.numbered(d, "id", ["group"], rows=100).collect():
        inside.setdefault((r["group"], r["total"]), []).append((r["id"], r["n"]))
    assert sorted(total for _, total in inside) == [333, 333, 334]
    assert all([n for _, n in sorted(x)] == list(range(len(x))) for x in inside.values())
