"""Events, metrics and search statistics as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(events: DataFrame, types: Sequence[str] = (), sources: Sequence[str] = (), least_priority: int | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Events that fit all conditions that are set."""
    out = events
    if types:
        out = out.where(F.col("event_type").isin(list(types)))
    if sources:
        out = out.where(F.col("source").isin(list(sources)))
    if least_priority is not None:
        out = out.where(F.col("priority") >= least_priority)
    for k, v in (metadata or {}).items():
        out = out.where(F.col("metadata")[k] == v)
    return out


def between(events: DataFrame, start=None, end=None, types: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    out = matching(events, types)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    out = out.orderBy("ts", "event_id")
    return out if limit is None else out.limit(limit)


def statistics(events: DataFrame, group: str = "event_type", value: str = "value", alert: float = 5.0) -> DataFrame:
    """group, n, total, mean, alerts (values above the bound)."""
    v = F.col(value)
    return events.groupBy(group).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.sum((v > alert).cast("long")).alias("alerts"))


def metrics(samples: DataFrame, prefix: str = "") -> DataFrame:
    """name, n, total, mean, errors and gauge (the last value) of samples (name, ts, id, value, error)."""
    s = samples.where(F.col("name").startswith(prefix))
    return s.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.sum(F.col("error").cast("long")).alias("errors"), F.max_by("value", F.struct("ts", "id")).alias("gauge"))


def retained(events: DataFrame, most: int) -> DataFrame:
    """The newest events."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(most)


def derived(events: DataFrame) -> DataFrame:
    """Events that others give rise to: a cache clear after each indexing, an alert for each service that is not healthy."""
    kind = F.when(F.col("event_type") == "vault.indexed", "cache.cleared").when((F.col("event_type") == "service.health") & (F.col("status") != "healthy"), "alert.raised")
    return events.withColumn("event_type", kind).where("event_type is not null")


def service_stats(services: DataFrame) -> DataFrame:
    return services.agg(F.count("*").alias("services"), F.sum((F.col("status") == "healthy").cast("long")).alias("healthy"), F.sum((F.col("status") != "healthy").cast("long")).alias("unhealthy"))


def reliability(errors: DataFrame) -> DataFrame:
    """component, errors, success, reliability = success - min(0.5, 0.1 * fallbacks), of rows (component, ok, fallback)."""
    per = errors.groupBy("component").agg(F.sum((~F.col("ok")).cast("long")).alias("errors"), F.avg(F.col("ok").cast("double")).alias("success"), F.sum(F.col("fallback").cast("long")).alias("fallbacks"))
    return per.select("component", "errors", "success", F.greatest(F.lit(0.0), F.col("success") - F.least(F.lit(0.5), 0.1 * F.col("fallbacks"))).alias("reliability"))


def pending(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending tasks, the highest priority and of equals the newest first."""
    out = tasks.where("status = 'pending'").orderBy(F.col("priority").desc(), F.col("created_at").desc(), "task_id")
    return out if limit is None else out.limit(limit)


def discovered(services: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Healthy services that have all the tags."""
    return services.where((F.col("status") == "healthy") & (F.size(F.array_except(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), "tags")) == 0))


def heartbeats(beats: DataFrame, as_of, seconds: int = 60) -> DataFrame:
    """service, last, status: unhealthy where the last beat (service, ts) is older than the time allowed."""
    last = beats.groupBy("service").agg(F.max("ts").alias("last"))
    age = F.lit(as_of).cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double")
    return last.withColumn("status", F.when(age > seconds, "unhealthy").otherwise("healthy"))


def vault_counts(events: DataFrame) -> DataFrame:
    """event_type, vault, n."""
    return events.groupBy("event_type", "vault").agg(F.count("*").alias("n"))


def error_summary(errors: DataFrame) -> DataFrame:
    """severity, component, n of (severity, component), with each severity's share of all errors."""
    per = errors.groupBy("severity", "component").agg(F.count("*").alias("n"))
    total = F.broadcast(errors.agg(F.count("*").alias("all")))  # one row
    return per.join(total).select("severity", "component", "n", (F.col("n") / F.col("all")).alias("share"))


def as_json(events: DataFrame, name: str = "json") -> DataFrame:
    """event_id and each whole event as JSON."""
    return events.select("event_id", F.to_json(F.struct("*")).alias(name))


def from_json(rows: DataFrame, schema: str, name: str = "json") -> DataFrame:
    return rows.select(F.from_json(name, schema).alias("e")).select("e.*")


def _field(value: Column, pattern: str) -> Column:
    """A field of a schedule: *, a number, */n, a/n, a-b, or a list of numbers."""
    if pattern == "*":
        return F.lit(True)
    if pattern.isdigit():
        return value == int(pattern)
    if "/" in pattern:
        start, step = pattern.split("/")
        first = 0 if start == "*" else int(start)
        return (value >= first) & ((value - first) % int(step) == 0)
    if "-" in pattern:
        return value.between(*map(int, pattern.split("-")))
    if "," in pattern:
        return value.isin([int(v) for v in pattern.split(",")])
    return F.lit(False)


def scheduled(ts: Column, schedule: str) -> Column:
    """Whether a time fits `minute hour day month weekday`; weekdays count from Monday, 0."""
    fields = schedule.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    parts = [F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.weekday(ts)]
    out = F.lit(True)
    for value, pattern in zip(parts, fields, strict=True):
        out = out & _field(value, pattern)
    return out


def next_run(ts: Column, schedule: str, days: int = 7) -> Column:
    """The first minute after a time that fits a schedule, within some days; null if none does."""
    start = F.date_trunc("minute", ts) + F.expr("interval 1 minute")
    minutes = F.sequence(start, start + F.expr(f"interval {days * 1440 - 1} minutes"), F.expr("interval 1 minute"))
    return F.array_min(F.filter(minutes, lambda t: scheduled(t, schedule)))


def type_distribution(events: DataFrame, column: str = "event_type") -> DataFrame:
    """How many rows there are of each type, commonest first."""
    return events.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def last_per_key(events: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key, last_value: the value that comes last in an order."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("last_value"))


def rate_window(events: DataFrame, key: str, value: str, order: Sequence[str], rows: int = 10) -> DataFrame:
    """Adds rate: the mean of a key's last values, its own included."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return events.withColumn("rate", F.avg(value).over(w))


def turns(conversations: DataFrame) -> DataFrame:
    """Adds before: the role of the turn before, null for the first."""
    return conversations.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))


def json_fields(events: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Fields of a JSON column as columns of their own."""
    return events.withColumns({n: F.get_json_object(column, f"$.{n}") for n in names})
