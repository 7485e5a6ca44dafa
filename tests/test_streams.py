"""Stores that rewrite what changes, change feeds that may be run again, and streams with timers."""

import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.sources import store
from marginalia.streaming import changes

NOTES = "vault_name string, path string, content string"
KEYS = ["vault_name", "path", "op", "event_time", "content", "moved_to"]


def notes(spark, rows):
    return spark.createDataFrame([("v", f"n{k}.md", t) for k, t in rows], NOTES)


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet")}


def content(table):
    return {r["path"]: r["content"] for r in table.read().collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = store.BucketedTable(spark, f"file://{tmp_path}", buckets=16)
    assert not t.exists()
    t.upsert(notes(spark, [(k, f"old {k}") for k in range(200)]))
    before = files(tmp_path)
    assert len(before) == 16
    touched = t.upsert(notes(spark, [(3, "new"), (500, "more")]))
    after = files(tmp_path)
    assert 1 <= len(touched) <= 2 and len(after - before) == len(touched) and before <= after  # the version before is kept
    want = {f"n{k}.md": f"old {k}" for k in range(200)} | {"n3.md": "new", "n500.md": "more"}
    assert content(t) == want
    t.delete(notes(spark, [(3, ""), (7, ""), (900, "")]))
    assert content(t) == {k: v for k, v in want.items() if k not in ("n3.md", "n7.md")}
    assert t.change(keys=notes(spark, [(901, "")]).limit(0)) == []
    assert len(files(tmp_path)) <= 16 + 3  # two versions' files, no older ones


def test_batches_are_applied_once(spark, tmp_path):
    t = store.BucketedTable(spark, f"file://{tmp_path}", buckets=8)
    assert t.change(notes(spark, [(1, "a"), (2, "b")]), feed="f", batch=0)
    assert t.change(notes(spark, [(1, "again")]), feed="f", batch=0) == [] and content(t)["n1.md"] == "a"
    assert t.change(notes(spark, [(1, "a")]), feed="f", batch=1, skip_equal=["content"]) == [] and t.has_batch("f", 1)
    assert t.change(notes(spark, [(1, "c")]), keys=notes(spark, [(2, "")]), feed="f", batch=2) and content(t) == {"n1.md": "c"}
    assert t.change(notes(spark, [(3, "x")]), feed="other", batch=0) and t.manifest().applied == {"f": 2, "other": 0}


def test_rows_with_new_and_clashing_columns(spark, tmp_path):
    t = store.BucketedTable(spark, f"file://{tmp_path}", key=["id"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "x", 5), (2, None, 6)], "id long, bucket string, n int"))
    t.upsert(spark.createDataFrame([(2, "y", 7, True), (3, "z", 8, None)], "id long, bucket string, n int, more boolean"))
    assert sorted(tuple(r) for r in t.read().select("id", "bucket", "n", "more").collect()) == [(1, "x", 5, None), (2, "y", 7, True), (3, "z", 8, None)]
    with pytest.raises(ValueError):
        store.BucketedTable(spark, f"file://{tmp_path}", key=["id"], buckets=5).upsert(t.read())


def test_a_lost_race_raises(spark, tmp_path):
    t = store.BucketedTable(spark, f"file://{tmp_path}", buckets=2)
    t.upsert(notes(spark, [(1, "a")]))
    old = t.manifest()
    t.upsert(notes(spark, [(1, "b")]))
    with pytest.raises(RuntimeError):
        t._commit(store.replace(old, number=old.number + 1))
    assert content(t) == {"n1.md": "b"}


def feed(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(KEYS, r))) for r in rows))


def test_feed_with_moves_and_replays(spark, tmp_path):
    src = tmp_path / "in"
    feed(src, 1, [("v", "a.md", "index", "2024-01-01T00:00:00Z", "one"), ("v", "b.md", "index", "2024-01-01T00:00:00Z", "two"), ("v", "a.md", "move", "2024-01-02T00:00:00Z", "one", "sub/a.md")])
    run = lambda: changes.follow(spark, f"file://{src}", f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    run()
    t = store.BucketedTable(spark, f"file://{tmp_path}/t")
    assert content(t) == {"sub/a.md": "one", "b.md": "two"}
    number = t.manifest().number
    batch = spark.createDataFrame([("v", "b.md", "delete", datetime(2030, 1, 1), None, None)], changes.SCHEMA)
    assert changes.apply_batch(t, batch, f"file://{tmp_path}/c", 0) == [] and t.manifest().number == number
    assert changes.apply_batch(t, batch, f"file://{tmp_path}/c", 1) and content(t) == {"sub/a.md": "one"}


def test_batches_that_fail_are_tried_again_and_put_aside(spark, tmp_path, monkeypatch):
    feed(tmp_path / "in", 1, [("v", "a.md", "index", "2024-01-01T00:00:00Z", "one")])
    tries = []

    def failing(*_):
        tries.append(1)
        raise OSError("no room")

    monkeypatch.setattr(changes, "apply_batch", failing)
    changes.follow(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/c", changes.dead_letters(f"file://{tmp_path}/dead"), 2, 0.01).awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/dead").collect()
    assert len(tries) == 3 and [(r["path"], r["reason"]) for r in rows] == [("a.md", "OSError: no room")]


def at(seconds):
    return datetime.fromtimestamp(1_700_000_000 + seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def streamed(spark, folder, schema, batches, transform):
    """Rows of a stream that reads one file after the other; the last files only move the watermark."""
    (folder / "in").mkdir(parents=True)
    names = [c.split()[0] for c in schema.split(", ")]
    for k, rows in enumerate(batches):
        (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        out = transform(spark.readStream.schema(schema).json(f"file://{folder}/in"))
        out.writeStream.format("json").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).json(f"file://{folder}/out")


def test_bursts_count_once(spark, tmp_path):
    rows = [("v", "a", "index", at(0), "1", None), ("v", "a", "index", at(1.5), "2", None), ("v", "a", "delete", at(1.5), None, None), ("v", "b", "index", at(1), "x", None), ("v", "a", "index", at(9), "3", None)]
    later = [("v", "z", "index", at(100), "", None)]
    got = streamed(spark, tmp_path, changes.SCHEMA, [rows[:2], rows[2:], later, later], lambda s: changes.debounced(s.withWatermark("event_time", "5 seconds"), "2 seconds"))
    pick = lambda df: sorted((r["path"], r["op"], r["content"], r["merged"]) for r in df.where("path <> 'z'").collect())
    assert pick(got) == [("a", "delete", None, 3), ("a", "index", "3", 1), ("b", "index", "x", 1)]
    batch = spark.read.schema(changes.SCHEMA).json(f"file://{tmp_path}/in")
    assert pick(changes.debounced(batch.where("path <> 'z'"), "2 seconds")) == pick(got)


@pytest.fixture
def timers(spark):
    before = {k: spark.conf.get(k, None) for k in changes.STATE_STORE}
    for k, v in changes.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_heartbeats_time_out(spark, tmp_path, timers):
    beats = [[("a", at(0)), ("b", at(2)), ("a", at(3))], [("a", at(20))], [("a", at(40)), ("b", at(41))], [("z", at(100))], [("z", at(101))]]
    got = streamed(spark, tmp_path, "service string, ts timestamp", beats, lambda s: changes.heartbeat_changes(s.withWatermark("ts", "1 seconds"), 5))
    seen = sorted((r["service"], r["at"] / 1000 - 1_700_000_000, r["status"]) for r in got.where("service <> 'z'").collect())
    table = spark.read.schema("service string, ts timestamp").json(f"file://{tmp_path}/in").where("service <> 'z'")
    spans = [(r["service"], r["up"] - 1_700_000_000, r["down"] - 1_700_000_000, r["beats"]) for r in changes.outages(table, 5).select("service", F.col("up_from").cast("double").alias("up"), F.col("down_at").cast("double").alias("down"), "beats").collect()]
    assert sorted(spans) == [("a", 0, 8, 2), ("a", 20, 25, 1), ("a", 40, 45, 1), ("b", 2, 7, 1), ("b", 41, 46, 1)]
    assert seen == sorted(x for s, up, down, _ in spans for x in ((s, up, "healthy"), (s, down, "unhealthy")))


def test_failures_are_retried_later_and_put_aside(spark, tmp_path, timers):
    schema, no, yes = "id string, ts timestamp, ok boolean", False, True
    outcomes = [[("m", at(0), no), ("k", at(0), yes)], [("m", at(10), no)], [("m", at(30), no), ("q", at(30), no)], [("q", at(50), yes)], [("z", at(100), yes)], [("z", at(101), yes)]]
    got = streamed(spark, tmp_path, schema, outcomes, lambda s: changes.retry_stream(s.withWatermark("ts", "1 seconds"), 2, 1.0))
    seen = sorted((r["id"], r["at"] / 1000 - 1_700_000_000, r["action"], r["failures"]) for r in got.where("id <> 'z'").collect())
    assert seen == [("k", 0, "done", 0), ("m", 1, "retry", 1), ("m", 12, "retry", 2), ("m", 30, "dead", 3), ("q", 31, "retry", 1), ("q", 50, "done", 0)]
    plan = changes.retry_plan(spark.read.schema(schema).json(f"file://{tmp_path}/in").where("id <> 'z'"), 2, 1.0)
    assert sorted((r["id"], r["due"] - 1_700_000_000, r["action"], r["failures"]) for r in plan.collect()) == seen


def test_migration_by_content(spark):
    rows = [("v", f"n{k}.md", f"text {k}") for k in range(3000)]
    source = spark.createDataFrame(rows, NOTES)
    same = source.repartition(7).select("content", "path", "vault_name")
    assert store.differences(source, same).count() == 0 and store.migrated(source, same)["valid"]
    changed = [r for r in rows if r[1] not in ("n5.md", "n6.md")] + [("v", "n6.md", "other"), ("w", "n7.md", "x"), rows[9]]
    target = spark.createDataFrame(changed, NOTES)
    got = {(r["vault_name"], r["path"]): (r["in_source"], r["in_target"]) for r in store.differences(source, target, parts=16, most_rows=40).collect()}
    assert got == {("v", "n5.md"): (True, False), ("v", "n6.md"): (True, True), ("w", "n7.md"): (False, True), ("v", "n9.md"): (True, True)}
    report = store.migrated(source, target)
    assert (report["missing"], report["extra"], report["changed"], report["valid"]) == (1, 1, 2, False) and report["success_rate"] == pytest.approx(100 * 2997 / 3000)
    assert store.migrated(source.limit(0), source.limit(0))["valid"]
