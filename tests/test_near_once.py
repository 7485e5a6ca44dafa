"""Density clusters compare all vectors once."""

from marginalia.operators import domains


def test_pairs_are_made_once(spark, monkeypatch):
    made, rows = spark.sparkContext.accumulator(0), [(0, 1), (1, 2), (0, 2), (2, 3)]

    def passed(batches, made=made):
        for b in batches:
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(domains, "similar_pairs", lambda *_: spark.createDataFrame(rows, "a long, b long").mapInArrow(passed, "a long, b long"))
    got = {r["id"]: r["cluster"] for r in domains.density_clusters(spark.range(5), 0.7).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: None} and made.value == len(rows)
