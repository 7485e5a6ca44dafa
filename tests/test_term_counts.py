"""Terms are counted in tasks, in parts of any size, and documents go round as one row each."""

import math

from marginalia.operators import terms


def test_counts_and_weights(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART", 3)
    rows = [(1, "red fox red fox"), (2, "Red hen"), (2, "hen hen"), (3, None), (4, "Été fox"), (5, "été")]
    d = terms.documents(spark.createDataFrame(rows, "id long, text string"), "id", stop=())
    vocab = terms.vocabulary(d, 6)
    assert {r["term"]: r["df"] for r in vocab.collect()} == {"red": 2, "fox": 2, "hen": 2, "ete": 2}
    w = terms.weights(d, vocab)
    got = {(r["id"], r["term"]): round(r["weight"], 9) for r in w.collect()}
    root = lambda *x: [round(k / math.sqrt(sum(y * y for y in x)), 9) for k in x]
    assert got == {(1, "red"): root(1, 1)[0], (1, "fox"): root(1, 1)[0], (2, "red"): root(1, 3)[0], (2, "hen"): root(1, 3)[1], (4, "ete"): root(1, 1)[0], (4, "fox"): root(1, 1)[0], (5, "ete"): 1.0}
    plain = spark.createDataFrame([(r["id"], r["terms"]) for r in d.collect()], "id long, terms array<string>")
    assert {(r["id"], r["term"]): round(r["weight"], 9) for r in terms.weights(plain, terms.vocabulary(plain, 6)).collect()} == got
    plan = w._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan
