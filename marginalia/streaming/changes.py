"""A change feed of notes kept current by Structured Streaming, and streams with state and timers.

File sources tell of no deletions, so changes come as rows (vault_name, path,
op, event_time, content, moved_to); a move is a deletion and an indexing. A
burst of changes of one note counts as its last one. Each micro-batch skips
notes whose checksum is stored already, and commits one version of the buckets
it touches under its batch number, so that a batch that is run again changes
nothing.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marginalia.sources.store import KEY, BucketedTable

SCHEMA = "vault_name string, path string, op string, event_time timestamp, content string, moved_to string"
#: The state store that streams with timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def expanded(changes: DataFrame) -> DataFrame:
    """Changes without moves: each is a deletion of the old path and an indexing of the new one at the same time."""
    one = lambda path, op, content: F.struct(path.alias("path"), op.alias("op"), content.alias("content"))
    parts = F.when(F.col("op") == "move", F.array(one(F.col("path"), F.lit("delete"), F.lit(None).cast("string")), one(F.col("moved_to"), F.lit("index"), F.col("content")))).otherwise(F.array(one(F.col("path"), F.col("op"), F.col("content"))))
    rest = [c for c in changes.columns if c not in ("path", "op", "content", "moved_to")]
    return changes.select(*rest, F.explode(parts).alias("c")).select(*rest, "c.*")


def _latest(columns: list[str]):
    """The last of a key's changes; of changes at one time a deletion counts as the later."""
    return F.max_by(F.struct(*columns), F.struct("event_time", F.col("op") == "delete", "content"))


def debounced(changes: DataFrame, quiet: str = "2 seconds", key: list[str] = KEY) -> DataFrame:
    """The last change of each burst: changes of a key no more than `quiet` apart, with their number.

    On a stream with a watermark a burst comes out once the watermark has
    passed its end; on a table all at once, with the same rows.
    """
    columns = [c for c in changes.columns if c not in key]
    bursts = changes.groupBy(F.session_window("event_time", quiet).alias("w"), *key).agg(_latest(columns).alias("c"), F.count("*").alias("merged"))
    return bursts.select(*key, *[F.col(f"c.{c}").alias(c) for c in columns], "merged")


def last_changes(batch: DataFrame) -> DataFrame:
    """The last change of each key."""
    columns = [c for c in batch.columns if c not in KEY]
    return batch.groupBy(*KEY).agg(_latest(columns).alias("c")).select(*KEY, "c.*")


def apply_batch(target: BucketedTable, batch: DataFrame, feed: str, number: int) -> list[int]:
    """Commits a micro-batch of changes; returns the buckets it wrote, none for a batch that is in already."""
    if target.has_batch(feed, number):
        return []
    last = last_changes(expanded(batch)).persist()
    try:
        notes = last.where("op = 'index'").select(*KEY, "content", F.col("event_time").alias("modified"), F.md5("content").alias("checksum"))
        return target.change(notes, last.where("op = 'delete'").select(*KEY), feed, number, ["checksum"])
    finally:
        last.unpersist()


def follow(spark: SparkSession, source: str, table: str, checkpoint: str, on_error: Callable[[DataFrame, Exception], None] | None = None, retries: int = 2, delay: float = 0.0) -> StreamingQuery:
    """Applies a folder of JSON change files to a bucketed table, all that is there now, and ends.

    A batch that fails is tried again after delay times the number of tries; one
    that still fails goes to on_error (a dead-letter sink) or stops the query.
    """
    target = BucketedTable(spark, table)

    def batch(df: DataFrame, number: int) -> None:
        for attempt in range(retries + 1):
            try:
                apply_batch(target, df, checkpoint, number)
                return
            except Exception as e:
                if attempt == retries:
                    if on_error is None:
                        raise
                    on_error(df, e)
                else:
                    time.sleep(delay * (attempt + 1))

    feed = spark.readStream.schema(SCHEMA).json(source)
    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letters(path: str) -> Callable[[DataFrame, Exception], None]:
    """A sink for batches that could not be applied: their rows and the reason, as Parquet."""

    def write(df: DataFrame, e: Exception) -> None:
        df.withColumn("reason", F.lit(f"{type(e).__name__}: {e}"[:1000])).write.mode("append").parquet(path)

    return write


class Heartbeats(StatefulProcessor):
    """A service is healthy at its first beat and after each outage, unhealthy once no beat has come for a time."""

    def __init__(self, seconds: float):
        self.allowed = int(1000 * seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted(int(t.value // 10**6) for df in rows for t in df["ts"])
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + self.allowed)
        said = []
        for t in beats:
            if last is None or t > last + self.allowed:
                if last is not None:
                    said.append((key[0], "unhealthy", last + self.allowed))
                said.append((key[0], "healthy", t))
            last = t if last is None else max(t, last)
        self.last.update((last,))
        self.handle.registerTimer(last + self.allowed)
        yield pd.DataFrame(said, columns=["service", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([(key[0], "unhealthy", expiredTimerInfo.getExpiryTimeInMs())], columns=["service", "status", "at"])

    def close(self) -> None:
        pass


def heartbeat_changes(beats: DataFrame, seconds: float = 60) -> DataFrame:
    """service, status, at (milliseconds) of a stream of beats (service, ts) with a watermark: a row for each change of health."""
    return beats.select("service", "ts").groupBy("service").transformWithStateInPandas(Heartbeats(seconds), "service string, status string, at long", "Append", "EventTime")


def outages(beats: DataFrame, seconds: int = 60) -> DataFrame:
    """service, up_from, down_at, beats: the spans in which beats (service, ts) were no more than some seconds apart, and when each was over."""
    spans = beats.groupBy(F.session_window("ts", f"{seconds} seconds").alias("w"), "service").agg(F.count("*").alias("beats"))
    return spans.select("service", F.col("w.start").alias("up_from"), F.col("w.end").alias("down_at"), "beats")


class Retries(StatefulProcessor):
    """What follows each outcome of handling a message: done, another try after delay times the failures so far, or the dead letters."""

    def __init__(self, most: int, seconds: float):
        self.most, self.delay = most, int(1000 * seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.failed = handle, handle.getValueState("failed", "n int")
        self.due = handle.getMapState("due", "at long", "n int")  # retries to come, by their times

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        outcomes = sorted((int(t.value // 10**6), bool(ok)) for df in rows for t, ok in zip(df["ts"], df["ok"], strict=True))
        n = self.failed.get()[0] if self.failed.exists() else 0
        due = {k[0]: v[0] for k, v in self.due.iterator()} if self.due.exists() else {}
        said, open_ = [], set(due)
        for t, ok in outcomes:
            for at in sorted(x for x in due if x <= t):  # came before this outcome, though the watermark is not there yet
                said.append((key[0], "retry", due.pop(at), at))
            n = 0 if ok else n + 1
            if ok:
                said.append((key[0], "done", 0, t))
                due.clear()
            elif n > self.most:
                said.append((key[0], "dead", n, t))
                n = 0
                due.clear()
            else:
                due[t + self.delay * n] = n
        for at in open_ - set(due):
            self.due.removeKey((at,))
            self.handle.deleteTimer(at)
        for at in set(due) - open_:
            self.due.updateValue((at,), (due[at],))
            self.handle.registerTimer(at)
        self.failed.update((n,))
        yield pd.DataFrame(said, columns=["id", "action", "failures", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        said = [(key[0], "retry", self.due.getValue((at,))[0], at)] if self.due.containsKey((at,)) else []
        self.due.removeKey((at,))
        yield pd.DataFrame(said, columns=["id", "action", "failures", "at"])

    def close(self) -> None:
        pass


def retry_stream(outcomes: DataFrame, most: int = 3, seconds: float = 1.0) -> DataFrame:
    """id, action (done, retry, dead), failures, at (milliseconds) of a stream of outcomes (id, ts, ok) with a watermark.

    A retry comes out once the watermark has passed its time or a later outcome
    of its message is there, so that whoever reads the stream can send it again.
    """
    return outcomes.select("id", "ts", "ok").groupBy("id").transformWithStateInPandas(Retries(most, seconds), "id string, action string, failures int, at long", "Append", "EventTime")


def retry_plan(outcomes: DataFrame, most: int = 3, seconds: float = 1.0, order: list[str] | None = None) -> DataFrame:
    """id, ts, action, failures, due of a table of outcomes (id, ts, ok): what retry_stream says, and when each retry is due.

    Failures count from the last success or dead letter before them.
    """
    order = order or ["ts"]
    own = Window.partitionBy("id").orderBy(*order)
    n = outcomes.withColumn("_after", F.sum(F.col("ok").cast("int")).over(own))
    n = n.withColumn("_k", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("id", "_after").orderBy(*order)))
    failures = F.when(F.col("ok"), 0).otherwise((F.col("_k") - 1) % (most + 1) + 1).cast("int")
    action = F.when(F.col("ok"), "done").when(failures > most, "dead").otherwise("retry")
    due = F.col("ts").cast("timestamp").cast("double") + F.when(action == "retry", failures * seconds).otherwise(0.0)
    return n.select("id", *order, action.alias("action"), failures.alias("failures"), due.alias("due"))


def running_statistics(events: DataFrame, group: str = "event_type") -> DataFrame:
    """Running counts and sums; write it in update or complete mode."""
    return events.groupBy(group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or sliding window with a watermark: an extension, not part of what notes need."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def subscribed(events: DataFrame, pattern: str) -> DataFrame:
    """Events whose type fits a pattern with * for anything."""
    return events.where(F.col("event_type").rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"))
