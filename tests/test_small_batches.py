"""What goes to Python workers: front matter without the text behind it."""

from pyspark.sql import functions as F

from marginalia.functions import markdown as M

BODY = "word " * 2000


def test_only_front_matter_goes_to_python(spark):
    rows = [(1, "---\nup: a\ntags: [x, y]\n---\n" + BODY), (2, BODY), (3, None), (4, "---  \nup: b\n---\x85\n" + BODY), (5, "---\nup: [\n---\n"), (6, " ---\nup: a\n---\n"), (7, "---\nup: a\n---\nx\n---\nup: b\n---\n")]
    d = spark.createDataFrame(rows, "id long, content string").select("id", M.frontmatter(F.col("content")).alias("f"))
    assert {r["id"]: r["f"] for r in d.collect()} == {1: {"up": "a", "tags": '["x", "y"]'}, 2: {}, 3: {}, 4: {"up": "b"}, 5: {}, 6: {}, 7: {"up": "a"}}
    assert "regexp_extract(content" in d._jdf.queryExecution().optimizedPlan().toString()
