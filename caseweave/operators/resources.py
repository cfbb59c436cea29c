"""Resources in time: concurrency, calendars, working time, delays, duration distributions."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import seconds_between
from caseweave.log import EventLog
from caseweave.operators import calendars as weekly
from caseweave.operators import intervals, simulation

#: Points at which a sample and a distribution are compared.
PROBABILITIES = tuple((k + 0.5) / 50 for k in range(50))


def concurrency(log: EventLog, resource: str = "resource", end: str = "end_timestamp") -> DataFrame:
    """(resource, most, events): how many events of a resource run at once at most, by a running sum over starts and ends.

    Intervals are half-open: an end frees the resource for a start at the same instant.
    """
    marks = F.array(F.struct(F.col("timestamp").alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))
    rows = log.events.where(F.col(end) > F.col("timestamp")).select(F.col(resource).alias("resource"), F.explode(marks).alias("m")).select("resource", "m.at", "m.step")
    added = lambda earlier, today: F.coalesce(earlier, F.lit(0)) + F.coalesce(today, F.lit(0))
    rows = intervals.running(rows, "resource", F.col("at"), ["at", "step"], F.col("step"), F.sum, added, "n", own=True)
    return rows.groupBy("resource").agg(F.max("n").alias("most"), F.count_if(F.col("step") == 1).alias("events"))


def in_calendar(events: DataFrame, calendar: DataFrame, start: str = "timestamp", end: str = "end_timestamp") -> DataFrame:
    """events with `inside`: begins and ends on one day within one interval of the calendar (weekday, begin_s, end_s).

    The calendar is at most a week of intervals and is broadcast.
    """
    second = lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
    slots = calendar.groupBy("weekday").agg(F.collect_list(F.struct("begin_s", "end_s")).alias("cw_slots"))
    rows = events.withColumn("cw_day", F.dayofweek(start) - 1)
    rows = rows.join(F.broadcast(slots.withColumnRenamed("weekday", "cw_day")), "cw_day", "left")
    fits = F.exists("cw_slots", lambda s: (s["begin_s"] <= second(F.col(start))) & (second(F.col(end)) <= s["end_s"]))
    same = F.to_date(start) == F.to_date(end)
    return rows.withColumn("inside", F.coalesce(same & fits, F.lit(False))).drop("cw_day", "cw_slots")


def working_seconds(events: DataFrame, calendar: DataFrame, key: str = "seq", start: str = "timestamp", end: str = "end_timestamp") -> DataFrame:
    """(case_id, key, working_s) of each event, told apart by case and key: the part of [start, end) inside the calendar's weekly intervals, over any number of days."""
    week = weekly.week_literal(calendar)
    us = weekly.working_between(week, weekly.micros(F.col(start)), weekly.micros(F.col(end)))
    return events.where(F.col(end) >= F.col(start)).select("case_id", F.col(key).alias("key"), F.round(us / 1e6, 6).alias("working_s"))


def hourly_calendar(log: EventLog, resource: str, support: float, least: int) -> DataFrame:
    """(resource, weekday, begin_s, end_s): hours a resource works, for resources with enough events."""
    n = log.events.groupBy(F.col(resource).alias("resource")).agg(F.count("*").alias("cw_n")).where(F.col("cw_n") >= least)
    hours = simulation.weekly_calendar(log, resource, support).join(n, "resource", "left_semi")
    return hours.select("resource", "weekday", (F.col("hour") * 3600).alias("begin_s"), (F.col("hour") * 3600 + 3599).alias("end_s"))


def calendars(log: EventLog, resource: str = "resource", support: float = 0.1, least: int = 20) -> DataFrame:
    """(resource, weekday, begin_s, end_s, origin) for every resource.

    Resources with too few events share the calendar of all such resources together;
    if these are too few as well, the whole log's; an empty one becomes all day, every day.
    """
    own = hourly_calendar(log, resource, support, least).withColumn("origin", F.lit("own"))
    everyone = log.events.select(F.col(resource).alias("resource")).where("resource is not null").distinct()
    missing = everyone.join(own.select("resource").distinct(), "resource", "left_anti")
    rest = EventLog(log.events.join(missing.withColumnRenamed("resource", resource), resource, "left_semi").withColumn(resource, F.lit("*")))
    pooled = hourly_calendar(rest, resource, support, least).drop("resource")
    whole = hourly_calendar(EventLog(log.events.withColumn(resource, F.lit("*"))), resource, support, least).drop("resource")
    always = log.df.sparkSession.createDataFrame([(d, 0, 86_399) for d in range(7)], "weekday int, begin_s int, end_s int")
    levels = [x.withColumn("origin", F.lit(name)).withColumn("rank", F.lit(k)) for k, (name, x) in enumerate((("pool", pooled), ("log", whole), ("always", always)))]
    shared = reduce(DataFrame.unionByName, levels)
    shared = shared.withColumn("best", F.min("rank").over(Window.partitionBy())).where(F.col("rank") == F.col("best"))
    return own.unionByName(missing.crossJoin(F.broadcast(shared.select("weekday", "begin_s", "end_s", "origin"))))


def delays(log: EventLog, resource: str = "resource", end: str = "end_timestamp") -> DataFrame:
    """(case_id, seq, activity, enabled_at, available_since, delay_s): waiting beyond the case's and the resource's readiness."""
    ready = simulation.enabling_event(log, end).where(F.col("enabled_at").isNotNull())
    free = simulation.resource_previous_end(log, resource, end, ("case_id",)).select("case_id", "seq", "available_since")
    rows = ready.join(free, ["case_id", "seq"]).join(log.events.select("case_id", "seq", "timestamp"), ["case_id", "seq"])
    since = F.greatest("enabled_at", "available_since")
    wait = F.greatest(seconds_between(since, F.col("timestamp")), F.lit(0.0))
    return rows.select("case_id", "seq", "activity", "enabled_at", "available_since", wait.alias("delay_s"))


def activity_delays(log: EventLog, resource: str = "resource", end: str = "end_timestamp") -> DataFrame:
    """Share of delayed events and mean delay of each activity."""
    rows = delays(log, resource, end).groupBy("activity")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("delay_s") > 0).cast("double")), 6).alias("delayed"), F.round(F.avg("delay_s"), 6).alias("mean_delay_s"))


def _distance(sample: Column, points: list[Column]) -> Column:
    """Mean absolute difference of quantiles, the Wasserstein distance on the grid."""
    return reduce(lambda a, b: a + b, (F.abs(sample[k] - p) for k, p in enumerate(points))) / len(points)


def fit_distributions(values: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, mean, std, family, distance): the family whose quantiles lie nearest to the sample's.

    Families are fitted by moments: fixed, exponential, normal, uniform, lognormal
    (positive samples), gamma by the Wilson-Hilferty quantiles. Quantiles instead of
    random draws, so results repeat.
    """
    v, z = F.col(column), [NormalDist().inv_cdf(p) for p in PROBABILITIES]
    rows = values.where(v.isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.avg(F.when(v > 0, F.ln(v))).alias("log_mean"), F.stddev_pop(F.when(v > 0, F.ln(v))).alias("log_std"),
        F.percentile(v, F.array(*map(F.lit, PROBABILITIES))).alias("q"),
    )
    mean, std, q = F.col("mean"), F.col("std"), F.col("q")
    shape = F.nullif(mean * mean, F.lit(0.0)) / F.nullif(std * std, F.lit(0.0))
    cube = lambda x: 1 - 1 / (9 * shape) + x / (3 * F.sqrt(shape))
    families = {
        "fixed": [mean for _ in z],
        "expon": [-mean * F.ln(F.lit(1 - p)) for p in PROBABILITIES],
        "norm": [mean + std * x for x in z],
        "uniform": [F.col("lo") + p * (F.col("hi") - F.col("lo")) for p in PROBABILITIES],
        "lognorm": [F.exp(F.col("log_mean") + F.col("log_std") * x) for x in z],
        "gamma": [mean * F.pow(F.greatest(cube(x), F.lit(0.0)), 3) for x in z],
    }
    usable = {"lognorm": F.col("lo") > 0, "gamma": (F.col("lo") >= 0) & (std > 0) & (mean > 0), "expon": F.col("lo") >= 0}
    options = [F.struct(F.round(F.when(usable.get(f, F.lit(True)), _distance(q, p)), 6).alias("distance"), F.lit(f).alias("family")) for f, p in families.items()]
    best = F.array_min(F.filter(F.array(*options), lambda o: o["distance"].isNotNull()))
    return rows.select(by, "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), best["family"].alias("family"), best["distance"].alias("distance"))


def redundant_series(series: DataFrame, flat: float = 5.0) -> DataFrame:
    """(constraint, redundant): series in percent that stay near 0, near 100, or within `flat` of their mean."""
    rows = series.groupBy("constraint").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    near = (F.col("hi") <= flat) | (F.col("lo") >= 100 - flat) | ((F.col("hi") <= F.col("mean") + flat) & (F.col("lo") >= F.col("mean") - flat))
    return rows.select("constraint", near.alias("redundant"))


def meets(log: EventLog, columns: tuple[str, ...] = (), least_events: int = 0, least_cases: int = 0) -> DataFrame:
    """(missing_columns, enough_events, enough_cases): whether an operator's needs are met; stops counting at the bounds."""
    events = log.events.select("case_id").limit(max(least_events, 1)).count()
    cases = log.events.select("case_id").distinct().limit(max(least_cases, 1)).count()
    row = (",".join(c for c in columns if c not in log.df.columns), events >= least_events, cases >= least_cases)
    return log.df.sparkSession.createDataFrame([row], "missing_columns string, enough_events boolean, enough_cases boolean")
