"""Fixtures of the note format, of graphs and of scores, with values worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions import scores as S
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.operators import domains, graph, notes, pairs, search
from marginalia.sources import store, vault
from marginalia.streaming import changes

NOTE = """---
tags: [ml, ai]
up: Parent
similar: [A, {target: B}]
---
# Title
See [[note|Alias]], [[doc#Sec]], ![[img.png]] and [x](sub/y.md) #topic end
> [!note] Head
> body
para ^blk1
"""


def test_parse(spark):
    r = M.parsed(spark.createDataFrame([(NOTE,), (None,), ("",)], "content string")).collect()
    p = r[0]
    assert p["tags"] == ["ai", "ml", "topic"]
    assert {k: v for k, v in p["relationships"].items()} == {"up": ["Parent.md"], "similar": ["A.md", "B.md"]}
    assert [(x["target"], x["alias"], x["section"]) for x in p["links"]] == [("note.md", "Alias", None), ("doc.md", None, "Sec"), ("img.png.md", None, None)]
    assert [(h["level"], h["text"], h["id"]) for h in p["headings"]] == [(1, "Title", "title")]
    assert [(c["type"], c["content"]) for c in p["callouts"]] == [("note", "Head\nbody")]
    assert [b["id"] for b in p["block_references"]] == ["blk1"]
    assert r[2]["tags"] == [] and r[2]["callouts"] == []


def test_links(spark):
    df = spark.createDataFrame([(NOTE,)], "content string").select(F.explode(M.typed_links(F.col("content"))).alias("l")).select("l.*")
    found = {(r["link_type"], r["target"]) for r in df.collect()}
    assert {("markdown_link", "sub/y.md"), ("embedded_link", "img.png"), ("wikilink", "note"), ("wikilink", "doc#Sec")} <= found
    got = spark.createDataFrame([("a/b.md", "../c.md#x"), ("a/b.md", "/r/./s.md"), ("a/b.md", "../../out.md")], "s string, t string").select(M.resolve_link(F.col("s"), F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == ["c.md", "r/s.md", None]


@pytest.mark.parametrize("text,label", [("I love this amazing product!", "positive"), ("This is terrible and awful!", "negative"), ("The weather is cloudy today.", "neutral"), ("", "neutral"), (None, "neutral")])
def test_sentiment(spark, text, label):
    s = spark.createDataFrame([(text,)], "t string").select(T.sentiment(F.col("t")).alias("s")).withColumn("l", T.sentiment_label(F.col("s"))).first()
    assert s["l"] == label
    if label == "negative":
        assert s["s"] == -1.0


@pytest.mark.parametrize("text,kind", [
    ("This algorithm uses machine learning and programming.", "technical"), ("The research study analyzes methodology and findings.", "academic"), ("Our business strategy focuses on market growth.", "business"),
    ("The creative design shows artistic inspiration.", "creative"), ("The experiment tests the hypothesis with data.", "scientific"), ("This is just a regular note about daily life.", "general"),
])
def test_content_type(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(T.content_type(F.col("t"))).first()[0] == kind


def test_features_of_empty_texts(spark):
    out = notes.content_features(spark.createDataFrame([(None,), ("",), ("école été",)], "content string")).collect()
    assert [r["total_words"] for r in out] == [0, 0, 2]
    assert out[0]["sentiment_score"] == 0.0 and out[1]["content_type"] == "general"


def test_scores(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(S.normalised_semantic(F.lit(-1.0))) == pytest.approx(0.818731, abs=1e-6)
    assert get(S.unified(F.lit(0.8187307530779818), F.lit(0.6))) == pytest.approx(0.731238, abs=1e-6)
    assert get(S.unified(F.lit(None).cast("double"), F.lit(0.6))) == pytest.approx(0.48)
    assert [get(S.quality_level(F.lit(x))) for x in (0.25, 0.2501, 0.75)] == ["seedling", "growing", "mature"]
    day = lambda a, b: get(S.day_difference(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))
    assert (day("2024-01-01 00:00:00", "2024-01-01 12:00:00"), day("2024-01-01 12:00:00", "2024-01-01 00:00:00")) == (1, 0)
    dist = lambda a, b: get(T.path_distance(F.lit(a), F.lit(b)))
    assert (dist("a/b/x.md", "a/c/y.md"), dist("a/x.md", "a/y.md"), dist("a/x.md", "a/x.md")) == (4, 2, 0)
    assert get(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


def test_simple_graph(spark):
    e = edges(spark, "A>B B>C C>A A>D D>E F>G")
    n = graph.nodes_of(e)
    m = graph.metrics(n, e).first()
    assert (m["nodes"], m["edges"]) == (7, 6) and m["density"] == pytest.approx(6 / 42)
    assert {r["id"]: r["centrality"] for r in graph.degrees(n, e).collect()}["A"] == pytest.approx(0.5)
    assert {r["id"]: r["coefficient"] for r in graph.clustering(e).collect()}["A"] == pytest.approx(1 / 3)
    assert graph.components(n, e).select("component").distinct().count() == 2
    rank = {r["id"]: r["rank"] for r in graph.pagerank(n, e, 60).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["A"] > rank["F"]
    between = {r["id"]: r["betweenness"] for r in graph.betweenness(e, n).collect()}
    # through A: B>C>A to D and E from B and C; C to B; through D: to E from A, B, C
    assert between["A"] * 30 == pytest.approx(5) and between["D"] * 30 == pytest.approx(3)
    near = graph.neighbourhood(e, "A", 1).collect()
    assert {r["id"] for r in near} == {"A", "B", "C", "D"} and [r["id"] for r in near if r["is_center"]] == ["A"]
    with pytest.raises(ValueError):
        graph.neighbourhood(e, "A", 6)
    p = spark.createDataFrame([("A", "E"), ("A", "F")], "a string, b string")
    assert {r["b"]: r["shortest_path"] for r in graph.shortest_paths(e, p).collect()} == {"E": 2, "F": 999}
    common = graph.common_neighbours(edges(spark, "X>Z Y>Z")).collect()
    assert len(common) == 1 and common[0]["adamic_adar"] == pytest.approx(1 / math.log(2))


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    n = graph.nodes_of(e)
    assert graph.components(n, e).count() == 0 and graph.pagerank(n, e).count() == 0 and graph.clustering(e).count() == 0


def test_density_clusters(spark):
    v = [(i, [1.0, 0.01 * i]) for i in range(4)] + [(10 + i, [0.01 * i, 1.0]) for i in range(4)] + [(99, [-1.0, -1.0])]
    got = {r["id"]: r["cluster"] for r in domains.density_clusters(spark.createDataFrame(v, "id long, embedding array<double>"), 0.9).collect()}
    assert {got[i] for i in range(4)} == {0} and {got[10 + i] for i in range(4)} == {10} and got[99] is None


def test_merge_prefers_semantic(spark):
    s = spark.createDataFrame([("meaning.md", 0.7), ("both.md", 0.6)], "path string, score double")
    k = spark.createDataFrame([("word.md", "name"), ("both.md", "content")], "path string, match_type string")
    assert [r["path"] for r in search.merged(s, k).collect()] == ["meaning.md", "both.md", "word.md"]


def test_negatives_are_seeded(spark):
    n = spark.range(50)
    taken = spark.createDataFrame([(0, 1)], "a long, b long")
    one, two = (sorted(map(tuple, pairs.random_negatives(n, taken, 40).collect())) for _ in range(2))
    assert one == two and len(one) == 40 and (0, 1) not in one and all(a < b for a, b in one)
    assert pairs.target_negatives(10, 5, 5.0) == 0


def test_vault_folder(spark, tmp_path):
    for name, text in {"Areas/CS/a.md": "# A", "Areas/b.md": "b", "Journaling/c.md": "c", "Areas/.hidden.md": "h", "Areas/x.txt": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "Areas/latin.md").write_bytes("é".encode("latin-1"))
    got = {r["path"]: r["content"] for r in vault.read_vault(spark, f"file://{tmp_path}").collect()}
    assert got == {"Areas/CS/a.md": "# A", "Areas/b.md": "b", "Areas/latin.md": "é"}
    assert vault.write_note(spark, f"file://{tmp_path}", "New/./n.md", "n") == "New/n.md" and (tmp_path / "New/n.md").read_text() == "n"
    with pytest.raises(ValueError):
        vault.safe_relative("../x")


def test_chunks_end(spark):
    text = "word " * 500
    spans = M.chunk_spans(text, 1000, 200, 50)
    assert spans[-1][1] == len(text) and len(spans) < 6 and all(a < b for a, b in spans)


def test_stream_applies_changes(spark, tmp_path):
    rows = [("v", "a.md", "index", "2024-01-01T00:00:00Z", "one"), ("v", "b.md", "index", "2024-01-01T00:00:00Z", "two"), ("v", "a.md", "delete", "2024-01-02T00:00:00Z", None)]
    src = tmp_path / "in"
    src.mkdir()
    keys = ["vault_name", "path", "op", "event_time", "content"]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in rows))
    run = lambda: changes.follow(spark, f"file://{src}", f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    run()
    table = store.BucketedTable(spark, f"file://{tmp_path}/t")
    assert [r["path"] for r in table.read().collect()] == ["b.md"]
    (src / "2.json").write_text(json.dumps(dict(zip(keys, ("v", "b.md", "index", "2024-01-03T00:00:00Z", "new"), strict=True))))
    run()
    assert [(r["path"], r["content"]) for r in table.read().collect()] == [("b.md", "new")]
