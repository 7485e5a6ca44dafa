"""Note and pair features, checks, schedules, backends, plugins and the command line on small tables."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from marginalia import __main__, plugins
from marginalia.api import Vaults
from marginalia.functions import markdown as M
from marginalia.operators import checks, domains, events, features, pairs, terms
from marginalia.operators import notes as N
from marginalia.settings import Settings
from marginalia.sources import backends

LONG = "Bread needs flour and water and a warm place to rise in for some hours"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'map<string,string>' if isinstance(v, dict) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("content,fields,want", [
    ("short", {}, features.NO_SUMMARY), (LONG, {"summary": " told "}, "told"),
    (f"# Baking\n\n## Dough\n\n{LONG}.", {}, "Note covering: Baking, Dough"), (f"{LONG}. More of it.", {}, LONG),
    (f"First words are here.\n\nThe **oven** function {LONG}.", {}, f"The oven function {LONG}."), ("x" * 230, {}, "x" * 200 + "..."),
    (f"A theory of baking. *yeast* is a fungus that makes gas from sugar. {LONG}", {}, "*yeast* is a fungus that makes gas from sugar"),
])
def test_semantic_summary(spark, content, fields, want):
    s = features.structure(F.col("content"))
    summary = features.semantic_summary(F.col("content"), F.col("fields"), s["kind"], s["topics"], features.key_concepts(F.col("content"), F.col("fields")))
    df = spark.createDataFrame([(content, fields)], "content string, fields map<string,string>")
    assert df.select(summary.alias("x")).first()["x"] == want


def test_progress_and_front_matter(spark):
    fields = {"status": "🌲", "aliases": "a, b,", "concepts": '["x", "y", "z"]', "summary": " "}
    signs = features.progress(F.col("tags"), F.col("fields"))
    assert one(spark, signs, tags=["z", "🌱"], fields=fields) == ["🌱", "🌲"]
    assert one(spark, features.quality_stage(F.col("fields"), signs), tags=[], fields=fields) == "mature"
    assert one(spark, features.quality_stage(F.col("fields"), signs), tags=[], fields={}) == "unknown"
    f = features.frontmatter_features(F.col("fields"), signs)
    assert [one(spark, f[k], tags=[], fields=fields) for k in ("aliases_count", "concepts_count", "sources_count", "has_summary_field")] == [2, 3, 0, False]
    flat = one(spark, features.flattened(F.col("fields")), fields={"k": '["p", "q"]', "m": '{"i": "1", "j": "two"}', "s": "plain"})
    assert flat == {"k_list": '["p", "q"]', "k_count": "2", "k_str": "p, q", "m_i": "1", "m_j": "two", "s": "plain"}


def test_terms(spark):
    assert "the" in terms.stop_words() and len(terms.stop_words()) > 100
    d = spark.createDataFrame([(1, "The École du pain: bread2 and bread_3 été"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["terms"] for r in terms.documents(d, "id", stop=("the", "and")).collect()}
    assert got == {1: ["ecole", "du", "pain", "bread2", "ete", "ecole du", "du pain", "pain bread2", "bread2 ete"], 2: [], 3: []}


def notes(spark):
    rows = [("Areas/a/one.md", LONG + " [[two]]", 100), ("Areas/a/two.md", "---\nx: 1\n---\n" + LONG, 90), ("Areas/b.md", "", 0), ("Journal/d.md", "private", 7), ("top.md", "t", 2 << 20)]
    return spark.createDataFrame(rows, "path string, content string, size long")


def test_vault_checks(spark):
    n = notes(spark)
    a = checks.areas(n, least=3).first()
    assert (a["exists"], a["notes"], a["subfolders"], a["size"], a["excluded"], a["valid"], a["privacy_percentage"]) == (True, 3, 1, 190, ["Journal"], True, 40.0)
    assert checks.vault(n, "Nowhere")["errors"] == ["there is no folder Nowhere", "there are no notes"]
    assert not checks.vault(n, "Areas")["valid"] and checks.vault(n, "Areas", least=3)["valid"]
    whole = checks.vault(n)
    assert whole["valid"] and "1 notes are large" in whole["warnings"] and whole["notes"] == 5
    assert checks.vault(n.limit(0))["errors"] == ["there are no notes"]
    r = checks.content_sample(n).first()
    assert (r["sampled"], r["content_ratio"], r["link_ratio"], r["metadata_ratio"]) == (5, 0.4, 0.2, 0.2)
    assert checks.areas_status(n, None)["protection"] == "none" and checks.areas_status(n, "Areas", 3)["protection"] == "high"
    with pytest.raises(ValueError):
        checks.enough(n, 6, "notes")
    assert checks.enough(n, 5, "notes") == 5


def test_reports(spark):
    n = spark.createDataFrame([("a", "a", 10, "x"), ("b", "b", 90, "y")], "id string, path string, word_count long, quality_stage string")
    p = spark.createDataFrame([("a", "b", True, 0.5), ("a", "c", False, 0.9)], "a string, b string, link_exists boolean, cosine_similarity double")
    r = checks.quality_report(n, p, ["word_count"])
    assert r["positive_ratio"] == 0.5 and not r["valid"] and "mend what is invalid before training" in r["recommendations"]
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (1e11, "y")], "v double, s string")
    assert checks.missing_features(df, ["v", "s", "w"]) == ["w is missing", "s is null", "v is not a number", "v is extreme"]
    filled = pairs.with_fallbacks(spark.createDataFrame([(None, float("nan"))], "community_id long, pagerank double"), ["community_id", "pagerank", "content_type"]).first()
    assert tuple(filled) == (-1, 0.001, "general")
    assert [tuple(x) for x in pairs.coerced(spark.createDataFrame([("1.5", "true"), ("x", None)], "n string, f string"), ["n"], ["f"]).collect()] == [(1.5, True), (0.0, False)]


def test_pairs_come_in_chunks(spark):
    n = spark.createDataFrame([(f"n{k}",) for k in range(23)], "id string")
    total = 23 * 22 // 2
    chunks = [{tuple(r) for r in pairs.enumerated(n, k, 50).collect()} for k in range(0, total, 50)]
    assert sum(map(len, chunks)) == total and set().union(*chunks) == {tuple(sorted(p)) for p in itertools.combinations([f"n{k}" for k in range(23)], 2)}
    assert pairs.enumerated(n.limit(1)).count() == 0


def test_negatives_are_as_many_as_there_are(spark):
    n = spark.createDataFrame([(k,) for k in range(12)], "id long")
    taken = spark.createDataFrame([(0, k) for k in range(1, 12)], "a long, b long")
    got = [tuple(r) for r in pairs.random_negatives(n, taken, 55).collect()]
    assert len(got) == len(set(got)) == 55 and all(0 < a < b for a, b in got)
    assert pairs.random_negatives(n, taken, 500).count() == 55 and pairs.random_negatives(n, taken, 7).count() == 7


def test_schedules(spark):
    t = datetime.datetime(2024, 1, 5, 10, 59, 30)  # a Friday
    df = spark.createDataFrame([(t,)], "ts timestamp")
    run = lambda s: df.select(events.next_run(F.col("ts"), s).alias("x")).first()["x"]
    assert run("*/15 * * * *") == datetime.datetime(2024, 1, 5, 11, 0) and run("30 9 * * 0-4") == datetime.datetime(2024, 1, 8, 9, 30)
    assert run("0 0 31 12 *") is None and run("5,10 11 * * *") == datetime.datetime(2024, 1, 5, 11, 5) and run("50/5 10 * * *") == datetime.datetime(2024, 1, 6, 10, 50)
    with pytest.raises(ValueError):
        events.scheduled(F.col("ts"), "* *")


def test_note_helpers(spark):
    assert one(spark, N.related(F.col("c")), c="[[a|b]] [x](http://h) [y](z) [http://q](r)") == ["a|b", "x", "y"]
    assert [one(spark, N.description(F.lit(4), F.col("k")), k=k) for k in ([], ["a"], ["a", "b", "c", "d"])] == ["Cluster of 4 related notes", "Notes about a", "Notes about a, b and c"]
    assert N.sampled(notes(spark), 2).count() == 2 and N.sampled(notes(spark), 2, above=9).count() == 5
    gaps = spark.createDataFrame([("high",)], "priority string")
    assert [r["priority"] for r in N.recommendations(0.2, gaps)] == ["medium", "high"] and N.recommendations(0.9, gaps.limit(0)) == []


@pytest.mark.parametrize("name", ["parquet", "view"])
def test_backends(spark, tmp_path, name):
    s = backends.create(spark, name, str(tmp_path / "v") if name == "parquet" else "vectors_of_test")
    assert s.stats()["rows"] == 0
    schema = "vault_name string, path string, embedding array<double>"
    s.upsert(spark.createDataFrame([("v", "a", [1.0, 0.0]), ("v", "b", [0.0, 1.0]), ("w", "c", [1.0, 1.0])], schema))
    s.upsert(spark.createDataFrame([("v", "b", [0.6, 0.8])], schema))
    assert s.stats() == {"rows": 3, "vaults": 2}
    assert [(r["path"], round(r["similarity"], 3)) for r in s.query([1.0, 0.0], 2, "v").collect()] == [("a", 1.0), ("b", 0.6)]
    s.delete(spark.createDataFrame([("v", "a")], "vault_name string, path string"))
    assert s.get("v", "a").count() == 0 and s.get("w", "c").count() == 1
    with pytest.raises(ValueError):
        backends.create(spark, "other", "")


def test_settings(spark):
    s = Settings.load(spark, {"MARGINALIA_SEARCH_LIMIT": "7", "MARGINALIA_EXCLUDED_FOLDERS": "A, B"})
    assert (s.search_limit, s.excluded_folders, s.areas_folder) == (7, ("A", "B"), "Areas")
    with pytest.raises(ValueError):
        Settings.load(None, {"MARGINALIA_SEARCH_LIMIT": "many"})
    with pytest.raises(ValueError):
        Settings.load(None, {"MARGINALIA_CHUNK_SIZE": "100"})


def test_domain_clusters_fall_back_to_means(spark):
    near, far = [(k, [1.0, 0.01 * k]) for k in range(6)], [(10 + k, [0.01 * k, 1.0]) for k in range(5)]
    schema = "id long, embedding array<double>"
    two = domains.domain_clusters(spark.createDataFrame(near + far, schema), 0.9)
    assert {frozenset(r["ids"]) for r in two.groupBy("cluster").agg(F.collect_set("id").alias("ids")).collect()} == {frozenset(range(6)), frozenset(range(10, 15))}
    one_ = domains.domain_clusters(spark.createDataFrame(near + [(20, [-1.0, 0.0]), (21, [-1.0, 0.1]), (22, [-1.0, -0.1]), (23, [-1.0, 0.2])], schema), 0.9, least=5)
    assert {r["cluster"].split("_")[0] for r in one_.collect()} == {"density", "means"}
    assert domains.domain_clusters(spark.createDataFrame([], schema)).count() == 0


def test_plugins():
    r = plugins.Registry()
    r.add("base", "extension")(lambda: 1)
    r.add("late", "extension", needs=("base",))(lambda: 2)
    r.add("early", "task", schedule="* * * * *")(lambda x: x + 1)
    assert r.start_order().index("base") < r.start_order().index("late") and r.names("extension") == ["base", "late"] and r.call("early", 4) == 5
    with pytest.raises(ValueError):
        r.add("base")(lambda: 3)
    r.add("lost", needs=("nothing",))(lambda: 0)
    with pytest.raises(LookupError):
        r.start_order()
    circle = plugins.Registry()
    circle.add("a", needs=("b",))(len)
    circle.add("b", needs=("a",))(len)
    with pytest.raises(ValueError):
        circle.start_order()
    seen, samples = [], []
    assert plugins.with_fallback(0, seen, "c")(lambda: 1 / 0)() == 0 and seen[0]["component"] == "c"
    with pytest.raises(ZeroDivisionError):
        plugins.with_fallback(None, seen)(lambda: 1 / 0)()
    assert plugins.timed(samples, "t", iter([1.0, 3.0]).__next__)(lambda: 5)() == 5 and samples == [("t", 2.0, False)]


def test_datasets_and_command_line(spark, tmp_path, capsys):
    root = tmp_path / "vault"
    for name, text in {"a/x.md": f"---\ntags: [🌱]\naliases: [p, q]\nup: y\n---\n# X\n{LONG} [[y]]", "a/y.md": f"# Y\n{LONG} and more [[x]] [[z]]", "b/z.md": f"{LONG} again"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    v = Vaults.read(spark, {"v": f"file://{root}"}, as_of="2030-01-01 00:00:00")
    rows = {r["id"]: r for r in v.notes_dataset().collect()}
    x, z = rows["a/x.md"], rows["b/z.md"]
    assert (x["quality_stage"], x["aliases_count"], x["semantic_up_links"], x["heading_count"], x["outgoing_links_count"], x["incoming_links_count"]) == ("seedling", 2, 1, 1, 1, 1)
    assert z["semantic_summary"] == f"{LONG} again" and z["pagerank_score"] > 0 and z["sentiment_label"] == "neutral" and len(x) >= 35
    pair = v.pairs_dataset(1.0).where("a = 'a/x.md' and b = 'a/y.md'").first()
    assert pair["link_exists"] and pair["shortest_path"] == 1 and 0 < pair["tfidf_similarity"] <= 1
    assert "## Organisation" in v.report(3) and "## Recommendations" in v.report(3)
    assert v.validate()["valid"] and v.graph_tables()[1].where("rel_type = 'UP'").count() == 1
    vault = ["--vault", f"v=file://{root}"]
    assert __main__.main([*vault, "stats"], spark) == 0 and __main__.main([*vault, "search", "again"], spark) == 0
    assert "b/z.md" in capsys.readouterr().out
    assert __main__.main([*vault, "index", "--store", f"file://{tmp_path}/store"], spark) == 0 and "'rows': 3" in capsys.readouterr().out
    assert __main__.main([*vault, "graph-index", "--out", f"file://{tmp_path}/graph"], spark) == 0 and spark.read.parquet(f"file://{tmp_path}/graph/nodes").count() >= 3
    assert __main__.main([*vault, "generate-dataset", "--out", f"file://{tmp_path}/set"], spark) == 0 and spark.read.option("header", True).csv(f"file://{tmp_path}/set/pairs").count() >= 2
    assert M.parsed(v.notes).count() == 3
