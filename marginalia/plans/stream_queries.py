"""Changes with time over the events table: bursts, retries, heartbeats, and checks of pair tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import vectors as V
from marginalia.operators import pairs
from marginalia.plans.base import query, six
from marginalia.session import table
from marginalia.streaming import changes

ISLANDS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < {gap}::BIGINT * 1000000 THEN 0 ELSE 1 END AS new FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY ts, {order})),
i AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ts, {order} ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


@query("r1_debounced_changes", "WITH c AS (SELECT 'v' AS vault_name, 'n' || user_id || '.md' AS path, CASE WHEN event_type = 'error' OR value < 10 THEN 'delete' ELSE 'index' END AS op, ts, event_type AS content, event_id FROM events), " + ISLANDS.format(gap=43200, rows="c", key="path", order="event_id") + " SELECT vault_name, path, island_op.op, island_op.content, epoch(island_op.ts)::DOUBLE AS at, merged FROM (SELECT vault_name, path, island, count(*) AS merged, arg_max({'op': op, 'content': content, 'ts': ts}, (ts, op = 'delete', content)) AS island_op FROM i GROUP BY vault_name, path, island)")
def debounced(spark, sf_dir):
    """Each user's events as changes of a note; a burst has no pause of twelve hours."""
    e = table(spark, sf_dir, "events")
    op = F.when((F.col("event_type") == "error") | (F.col("value") < 10), "delete").otherwise("index")
    c = e.select(F.lit("v").alias("vault_name"), F.concat(F.lit("n"), "user_id", F.lit(".md")).alias("path"), op.alias("op"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("content"))
    out = changes.debounced(c, "43200 seconds")
    return out.select("vault_name", "path", "op", "content", F.col("event_time").cast("double").alias("at"), "merged")


@query("r10_outages", "WITH " + ISLANDS.format(gap=86400, rows="events", key="user_id", order="event_id") + " SELECT user_id AS service, epoch(min(ts))::DOUBLE AS up_from, epoch(max(ts))::DOUBLE + 86400 AS down_at, count(*) AS beats FROM i GROUP BY user_id, island")
def outages(spark, sf_dir):
    """Users as services that are down after a day without an event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.col("ts").cast("timestamp").alias("ts"))
    out = changes.outages(e, 86400)
    return out.select("service", F.col("up_from").cast("double").alias("up_from"), F.col("down_at").cast("double").alias("down_at"), "beats")


@query("r5_retry_plan", "WITH o AS (SELECT user_id, event_id, ts, value >= 60 AS ok FROM events WHERE value IS NOT NULL), a AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS after FROM o), k AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, after ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a), f AS (SELECT *, CASE WHEN ok THEN 0 ELSE (k - 1) % 4 + 1 END::BIGINT AS failures FROM k) SELECT user_id AS id, event_id, failures, CASE WHEN ok THEN 'done' WHEN failures > 3 THEN 'dead' ELSE 'retry' END AS action, epoch(ts)::DOUBLE + CASE WHEN NOT ok AND failures <= 3 THEN 30.0 * failures ELSE 0 END AS due FROM f")
def retry_plan(spark, sf_dir):
    """Each user's events as tries of one message that fail below a value."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") >= 60).alias("ok"))
    return changes.retry_plan(e, 3, 30.0, ["ts", "event_id"]).select("id", "event_id", F.col("failures").cast("long").alias("failures"), "action", "due")


PAIRS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s, a.label = b.label AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir):
    """Neighbouring vectors, linked where their labels agree."""
    v = table(spark, sf_dir, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.col("label").alias("s")), v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("label").alias("t"))
    return a.join(b, "a").select("a", "b", V.cosine(F.col("x").cast("array<double>"), F.col("y").cast("array<double>")).alias("cosine_similarity"), (F.col("s") == F.col("t")).alias("link_exists"))


@query("v4_pair_checks", f"WITH {PAIRS}, r AS (SELECT avg(y::INT) AS pos, min(s) AS lo, max(s) AS hi, stddev_samp(s) AS sd, sum((a = b)::INT) AS own, count(*) - count(DISTINCT (least(a, b), greatest(a, b))) AS twice FROM p) SELECT unnest(list_filter([CASE WHEN pos = 0 THEN 'no positive pairs' WHEN pos > 0.8 THEN 'too many positive pairs' WHEN pos < 0.05 THEN 'too few positive pairs' END, CASE WHEN lo < -1 OR hi > 1 THEN 'similarity out of range' END, CASE WHEN sd < 0.01 THEN 'similarity hardly varies' END, CASE WHEN own > 0 THEN 'self pairs' END, CASE WHEN twice > 0 THEN 'repeated pairs' END, 'pairs checked'], lambda x: x IS NOT NULL)) AS finding FROM r")
def pair_checks(spark, sf_dir):
    found = pairs.check_pairs(_pairs(spark, sf_dir))
    return spark.createDataFrame([(f,) for f in [*found, "pairs checked"]], "finding string")


@query("v5_consistency", f"WITH {PAIRS}, u AS (SELECT a AS id FROM p UNION SELECT b FROM p), r AS (SELECT count(*)::DOUBLE AS n, count(doc_id) AS known FROM u LEFT JOIN documents ON doc_id = id), d AS (SELECT count(*) AS total FROM documents) SELECT round((n - known) / n, 6) AS missing, round(known / total, 6) AS coverage, (n - known) / n <= 0.1 AS valid, known / total < 0.5 AS warning FROM r, d")
def consistency(spark, sf_dir):
    """Pairs of vectors against the documents of their numbers."""
    r = pairs.consistency(_pairs(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    return spark.createDataFrame([(round(r["missing"], 6), round(r["coverage"], 6), r["valid"], r["warning"])], "missing double, coverage double, valid boolean, warning boolean")
