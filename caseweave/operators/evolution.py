"""How a log changes over time: arrivals, work in progress, activity mix, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import seconds_between, time_ranked
from caseweave.log import EventLog

GRAINS = {"day": "1 day", "week": "1 week", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def _calendar(bounds: DataFrame, grain: str) -> DataFrame:
    """All periods from the first to the last."""
    step = F.expr(f"INTERVAL {GRAINS[grain]}")
    period = F.explode(F.sequence(F.date_trunc(grain, F.col("lo")), F.date_trunc(grain, F.col("hi")), step))
    return bounds.where(F.col("lo").isNotNull()).select(period.alias("period")).select(F.col("period").cast("timestamp_ntz").alias("period"))


def _period(grain: str, column: str) -> Column:
    return F.date_trunc(grain, F.col(column)).cast("timestamp_ntz")


def evolution(log: EventLog, grain: str = "day") -> DataFrame:
    """Arrivals, completions, events and work in progress in each period, empty ones included."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"))
    frame = _calendar(t.agg(F.min("a").alias("lo"), F.max("b").alias("hi")), grain)
    marks = t.select(F.explode(F.array(F.struct(_period(grain, "a").alias("period"), F.lit(1).alias("arr"), F.lit(0).alias("com")), F.struct(_period(grain, "b").alias("period"), F.lit(0).alias("arr"), F.lit(1).alias("com")))).alias("x"))
    marks = marks.groupBy("x.period").agg(F.sum("x.arr").alias("arrivals"), F.sum("x.com").alias("completions"))
    events = log.events.groupBy(_period(grain, "timestamp").alias("period")).agg(F.count("*").alias("events"))
    rows = frame.join(marks, "period", "left").join(events, "period", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = rows.select("period", zero("arrivals"), zero("completions"), zero("events"))
    running = F.sum(F.col("arrivals") - F.col("completions")).over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("wip", running)


def activity_mix(log: EventLog, grain: str = "day", top: int = 12) -> DataFrame:
    """Events by period and activity, the most frequent activities by name and the rest as Other; full grid."""
    counts = log.events.groupBy("activity").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("activity")))
    names = counts.select("activity", F.when(rank <= top, F.col("activity")).otherwise("Other").alias("label"))
    rows = log.events.join(names, "activity").groupBy(_period(grain, "timestamp").alias("period"), "label").agg(F.count("*").alias("n"))
    frame = _calendar(log.events.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")), grain)
    grid = frame.crossJoin(F.broadcast(names.select("label").distinct()))
    return grid.join(rows, ["period", "label"], "left").select("period", "label", F.coalesce("n", F.lit(0)).alias("n"))


def dotted_ranks(log: EventLog) -> DataFrame:
    """(case_id, y): cases numbered from 0 by first event."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    return time_ranked(t, "start", "case_id").select("case_id", (F.col("rank") - 1).alias("y"))


def dotted_chart(log: EventLog, max_points: int = 8_000) -> DataFrame:
    """Events as points (y, timestamp, activity); at most max_points of them, by a fixed hash."""
    points = log.events.join(dotted_ranks(log), "case_id").select("y", "timestamp", "activity", "seq")
    return points.orderBy(F.xxhash64("y", "timestamp", "activity", "seq"), "y", "seq").limit(max_points)


def slices_absolute(log: EventLog, n: int) -> DataFrame:
    """(case_id, slice): case starts in n equal bins, right-closed, the smallest included; one bin for one instant."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    bounds = t.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    at = seconds_between(F.col("lo"), F.col("start")) / seconds_between(F.col("lo"), F.col("hi"))
    k = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.greatest(F.ceil(at * n) - 1, F.lit(0)))
    return t.crossJoin(F.broadcast(bounds)).select("case_id", "start", k.cast("int").alias("slice"))


def calendar_grain(days: float) -> str:
    """The grain for a span: day to 60 days, week to 540, month to 2200, then year."""
    return "day" if days <= 60 else "week" if days <= 540 else "month" if days <= 2200 else "year"


def slices_calendar(log: EventLog, grain: str) -> DataFrame:
    """(slice, n_cases): case starts by calendar period, empty periods included."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    frame = _calendar(t.agg(F.min("start").alias("lo"), F.max("start").alias("hi")), grain)
    found = t.groupBy(_period(grain, "start").alias("period")).agg(F.count("*").alias("n_cases"))
    return frame.join(found, "period", "left").select(F.col("period").alias("slice"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def slices_sliding(log: EventLog, window_days: int = 30, step_days: int = 7) -> DataFrame:
    """(case_id, slice): every window [first start + k steps, + window) that holds a case's start.

    The windows of a start follow by arithmetic, so no table of windows is joined.
    """
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    lo = t.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    rows = t.crossJoin(F.broadcast(lo))
    day = F.lit(86_400_000_000)
    at = F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("start"))
    last = F.floor(at / (day * step_days)).cast("long")
    first = F.greatest(F.floor((at - day * window_days) / (day * step_days)).cast("long") + 1, F.lit(0))
    return rows.where(first <= last).select("case_id", "start", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("slice"))
