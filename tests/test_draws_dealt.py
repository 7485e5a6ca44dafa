"""Draws of one large group are made by many tasks, and their graph is made once."""

from pyspark.sql import functions as F

from marginalia.operators import pairs
from marginalia.plans import graph_queries


def test_draws_of_one_group_are_dealt(spark, monkeypatch):
    keep, tasks = pairs.keep, []

    def seen(df, name, *a, **k):
        out = keep(df, name, *a, **k)
        if name == "draws":
            tasks.append(out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(pairs, "keep", seen)
    nodes, taken = spark.range(300), spark.createDataFrame([(k, k + 1) for k in range(299)], "a long, b long")
    whole = sorted(tuple(r) for r in pairs.random_negatives(nodes, taken, 400).collect())
    monkeypatch.setattr(pairs, "TURNS", 16)
    assert sorted(tuple(r) for r in pairs.random_negatives(nodes, taken, 400).collect()) == whole and len(set(whole)) == 400
    assert max(tasks) > 4


def test_the_graph_is_made_once(spark, monkeypatch):
    made, rows = spark.sparkContext.accumulator(0), [(a, (a * 7 + 1) % 50) for a in range(50) if a != (a * 7 + 1) % 50]

    def passed(batches, made=made):
        for b in batches:
            made.add(b.num_rows)
            yield b

    e = spark.createDataFrame(rows, "src long, dst long").mapInArrow(passed, "src long, dst long")
    monkeypatch.setattr(graph_queries, "sparse", lambda *_: e)
    assert graph_queries.random_negatives(spark, "").count() > 0
    assert made.value == len(rows)
