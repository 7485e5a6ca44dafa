"""The served tools over a small linked vault."""

import pytest
from pyspark.sql import functions as F

from marginalia.api import Cache, Vaults
from marginalia.functions.encoder import hashing_encoder
from marginalia.operators import links, topics

FILES = {
    "Areas/ml/deep_learning.md": "---\ntags: [ml]\nup: machine_learning\n---\n# Deep learning\nBuilds on [[machine_learning]] and [[Missing note]].",
    "Areas/ml/machine_learning.md": "# Machine learning\nSee [[deep_learning.md|Deep]], [text](../notes/other.md) and [site](https://example.com/a.md). #ml",
    "Areas/notes/other.md": "Other words about cooking and bread.",
    "weather.md": "The weather is cloudy today. [[weather]]",
}


@pytest.fixture(scope="module")
def vaults(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Vaults.read(spark, {"v": f"file://{root}"}, as_of="2030-01-01 00:00:00")


def test_links(vaults):
    got = {(r["source"].split("/")[-1], r["target"], r["valid"]) for r in vaults.links().collect()}
    assert ("deep_learning.md", "Areas/ml/machine_learning.md", True) in got
    assert ("machine_learning.md", "Areas/notes/other.md", True) in got and ("machine_learning.md", "Areas/ml/deep_learning.md", True) in got
    assert any(not v and "Missing note" in t for _, t, v in got) and not any("example.com" in t for _, t, _ in got)
    s = links.statistics(vaults.links(), vaults.notes).first()
    assert (s["links"], s["broken"], s["self_links"], s["both_ways"], s["notes_without_links"]) == (5, 1, 1, 1, 1)
    assert links.acceptable(vaults.links())
    nodes, edges = links.graph_tables(vaults.parsed())
    assert nodes.where("kind = 'Tag'").count() == 1 and edges.where("rel_type = 'UP'").count() == 1
    assert nodes.where("id = 'Missing note.md'").first()["title"] == "Missing note"


def test_search(vaults):
    assert vaults.search_semantic("cooking bread words", 1, metric="cosine").first()["path"] == "Areas/notes/other.md"
    assert [r["path"] for r in vaults.search_vault("weather").collect()] == ["weather.md"]
    assert vaults.search_combined("weather", 2).first()["path"] == "weather.md"
    near = {r["id"]: r["distance"] for r in vaults.search_graph("Areas/ml/deep_learning.md", 2).collect()}
    assert near == {"Areas/ml/deep_learning.md": 0, "Areas/ml/machine_learning.md": 1, "Areas/notes/other.md": 2}
    assert vaults.search_graph("weather").where("id = 'weather.md'").count() == 1
    with pytest.raises(ValueError):
        vaults.search_semantic(" ", 5)
    assert vaults.read_note("v", "weather.md").count() == 1 and vaults.list_vaults().first()["notes"] == 4 and all(vaults.health().values())


def test_reports(vaults):
    q = {r["path"]: r for r in vaults.assess_quality().collect()}
    assert q["Areas/ml/deep_learning.md"]["broken"] == 1 and q["weather.md"]["inbound"] == 0
    assert set(vaults.context()) == {"organisation", "depth", "clusters", "folders", "quality", "links"}
    assert vaults.analyze_domains(0.99)["members"].count() == 0


def test_datasets(vaults):
    n = vaults.notes_dataset()
    assert n.count() == 4 and {"content_type", "pagerank_score", "tag_count", "incoming_links_count"} <= set(n.columns)
    p = vaults.pairs_dataset(1.0)
    assert p.where("link_exists").count() == 2 and p.where("not link_exists").count() == 2
    assert p.where("a >= b").count() == 0


def test_topics(spark):
    docs = spark.createDataFrame([(i, "apple bread cook" if i % 2 else "graph node edge") for i in range(20)], "id long, text string")
    for method in ("lda", "kmeans"):
        model = topics.fit(docs, topics=2, method=method, rounds=5)
        out = topics.predict(model, docs)
        assert out.groupBy((F.col("id") % 2).alias("p")).agg(F.count_distinct("dominant_topic").alias("n")).agg(F.max("n")).first()[0] == 1
        found = topics.topic_words(model, 3)
        assert len(found) == 2 and {frozenset(w for w in x["words"] if " " not in w) & frozenset("apple bread cook graph node edge".split()) != frozenset() for x in found} == {True}
        assert all(len(x["weights"]) == len(x["words"]) and x["weights"] == sorted(x["weights"], reverse=True) for x in found)
        assert {r["documents"] for r in topics.topic_sizes(out).collect()} == {10}


def test_topic_weights_are_those_of_the_term_tables(spark):
    """The features are counts times smooth idf, of length one, as terms.weights gives them."""
    from marginalia.operators import terms

    texts = ["red green blue", "red green", "red yellow yellow", "blue yellow pink", "pink blue red"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = topics.fit(docs, topics=2, rounds=2, max_df=1.0)
    vocab = model.stages[0].vocabulary
    rows = model.stages[2].transform(model.stages[1].transform(model.stages[0].transform(topics._terms(docs, "text")))).select("id", "features").collect()
    got = {(r["id"], vocab[i]): r["features"][int(i)] for r in rows for i in r["features"].indices.tolist()}
    d = terms.documents(docs, "id")
    want = {(r["id"], r["term"]): r["weight"] for r in terms.weights(d, terms.vocabulary(d, 5, 2, 1.0)).collect()}
    assert got == pytest.approx(want)


def test_only_terms_of_the_vocabulary_leave_the_texts(spark):
    """All terms are counted where they are made; what goes on to the model is at most the vocabulary."""
    docs = spark.createDataFrame([(i, " ".join(f"word{i * 7 + k}" for k in range(50)) + " apple bread" * (1 + i % 3)) for i in range(30)], "id long, text string")
    model = topics.fit(docs, topics=2, method="kmeans", rounds=2, max_features=3, max_df=1.0, starts=1)
    assert model.stages[0].vocabulary[0] in ("apple", "bread") and set(model.stages[0].vocabulary) == {"apple", "bread", "apple bread"}
    rows = topics._terms(docs, "text", model.stages[0].vocabulary).collect()
    assert all(sorted(r["tokens"]) == sorted((1 + r["id"] % 3) * ["apple", "bread", "apple bread"]) for r in rows)
    assert topics.predict(model, docs).count() == 30


def test_cache():
    now = [0.0]
    c = Cache(2, 10, clock=lambda: now[0])
    made = []
    get = lambda k: c.get(k, lambda: made.append(k) or k)
    get("a"), get("b"), get("a"), get("c"), get("b")
    assert made == ["a", "b", "c", "b"]
    now[0] = 11
    get("b")
    assert made[-1] == "b" and len(made) == 5 and c.stats()["hits"] == 1


def test_hashing_encoder():
    v = hashing_encoder(32)(["a b", "a b", "", "c"])
    assert (v[0] == v[1]).all() and not v[2].any() and abs((v[3] ** 2).sum() - 1) < 1e-5
