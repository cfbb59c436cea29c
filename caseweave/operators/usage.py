"""Usage analytics over plain event tables: user_id, session_id, event_type, occurred_at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import seconds_between


def session_kpis(events: DataFrame) -> DataFrame:
    """Sessions, users, mean session seconds and events, and the share of sessions with a single event."""
    s = events.groupBy("session_id").agg(F.count("*").alias("n"), F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b"))
    s = s.agg(
        F.count("*").alias("sessions"),
        F.round(F.avg(seconds_between(F.col("a"), F.col("b"))), 6).alias("avg_session_s"),
        F.round(F.avg("n"), 6).alias("avg_events"),
        F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("bounce_rate"),
    )
    return s.crossJoin(F.broadcast(events.agg(F.count_distinct("user_id").alias("users"))))


def recency_buckets(events: DataFrame, now) -> DataFrame:
    """Users by the age of their last event: today, 7d, 30d, older."""
    last = events.groupBy("user_id").agg(F.max("occurred_at").alias("last"))
    days = F.date_diff(F.to_date(F.lit(now)), F.to_date("last"))
    bucket = F.when(days <= 0, "today").when(days < 7, "7d").when(days < 30, "30d").otherwise("older")
    return last.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("users"))


def per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("occurred_at").alias("hour")).agg(F.count("*").alias("n"))


def weekday(events: DataFrame) -> DataFrame:
    """Events by weekday, Sunday = 0."""
    return events.groupBy((F.dayofweek("occurred_at") - 1).alias("weekday")).agg(F.count("*").alias("n"))


def top(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def durations(jobs: DataFrame, by: str) -> DataFrame:
    """Jobs, mean and longest seconds by a column; jobs has started_at and finished_at."""
    s = seconds_between(F.col("started_at"), F.col("finished_at"))
    return jobs.groupBy(by).agg(F.count("*").alias("jobs"), F.round(F.avg(s), 6).alias("avg_s"), F.max(s).alias("max_s"))


def upsert_sessions(sessions: DataFrame, batch: DataFrame) -> DataFrame:
    """Sessions (session_id, user_id, started_at, last_seen, events) with a batch of events added."""
    new = batch.groupBy("session_id", "user_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_seen"), F.count("*").alias("events"))
    both = sessions.unionByName(new).groupBy("session_id", "user_id")
    return both.agg(F.min("started_at").alias("started_at"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))


def retained(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Events at or after their user's cutoff (user_id, cutoff); users without one keep all."""
    rows = events.join(limits, "user_id", "left")
    return rows.where(F.col("cutoff").isNull() | (F.col("occurred_at") >= F.col("cutoff"))).drop("cutoff")


def activation(installs: DataFrame, runs: DataFrame, key: str = "module_id") -> DataFrame:
    """Installs and runs by module, 0 where there is none."""
    a, b = installs.groupBy(key).agg(F.count("*").alias("installs")), runs.groupBy(key).agg(F.count("*").alias("runs"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("installs", F.lit(0)).alias("installs"), F.coalesce("runs", F.lit(0)).alias("runs"))


def to_event_log(events: DataFrame, case: str = "session") -> DataFrame:
    """Usage events as a log: the case is the session or the user, the user for server events."""
    session = F.when(F.col("source") == "server", F.col("user_id")).otherwise(F.col("session_id"))
    which = F.col("user_id") if case == "user" else session
    rows = events.select(which.cast("string").alias("case_id"), F.col("event_type").alias("activity"), F.col("occurred_at").alias("timestamp"))
    w = Window.partitionBy("case_id").orderBy("timestamp", "activity")
    return rows.where("case_id is not null").withColumn("seq", F.row_number().over(w))


def matching(events: DataFrame, user_id=None, prefix: str | None = None, start=None, end=None) -> DataFrame:
    """Events of a user, of types that begin with a prefix in any case, and from start up to, not including, end."""
    rows = events if user_id is None else events.where(F.col("user_id") == user_id)
    if prefix is not None:
        rows = rows.where(F.startswith(F.lower("event_type"), F.lit(prefix.lower())))
    if start is not None:
        rows = rows.where(F.col("occurred_at") >= F.lit(start))
    return rows if end is None else rows.where(F.col("occurred_at") < F.lit(end))


def preview(events: DataFrame) -> DataFrame:
    """One row: what an export would hold."""
    counts = (F.count_distinct(c).alias(n) for c, n in (("user_id", "users"), ("session_id", "sessions"), ("event_type", "types")))
    return events.agg(F.count("*").alias("events"), *counts, F.min("occurred_at").alias("earliest"), F.max("occurred_at").alias("latest"))


def summary(events: DataFrame) -> DataFrame:
    """Events of each type with the first and the last time."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))


def statuses(jobs: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """(status, n, active): jobs by status, and whether it is one of the active ones."""
    return jobs.groupBy("status").agg(F.count("*").alias("n")).withColumn("active", F.col("status").isin(*active))
