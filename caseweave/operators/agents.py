"""What an agent simulation reads from a log: padded traces, coded resources, hand-overs, next activities by agent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.log import EventLog

#: Activity of the artificial event that closes a case, and the agent before its first event.
END = "zzz_end"
START = "-1"


def padded(log: EventLog, end: str = END) -> DataFrame:
    """Events with one more event per case: a copy of its last one, under the activity `end`."""
    names = log.events.columns
    last = log.events.groupBy("case_id").agg(F.max_by(F.struct(*names), F.struct("timestamp", "seq")).alias("x"))
    return log.events.unionByName(last.select("x.*").withColumn("activity", F.lit(end)))


def resource_codes(log: EventLog, resource: str = "resource", missing: str = "undefined") -> DataFrame:
    """(resource, code): resources numbered from 0 by first appearance; events without one count as `missing`."""
    name = F.coalesce(F.col(resource).cast("string"), F.lit(missing))
    first = log.events.groupBy(name.alias("resource")).agg(F.min(F.struct("timestamp", "seq")).alias("at"))
    return first.select("resource", (F.row_number().over(Window.orderBy("at", "resource")) - 1).alias("code"))


def with_ends(log: EventLog, end: str = "end_timestamp") -> EventLog:
    """The log with an end for every event: its start where it has none."""
    given = F.col(end) if end in log.df.columns else F.lit(None).cast("timestamp_ntz")
    return EventLog(log.df.withColumn(end, F.coalesce(given, F.col("timestamp"))), log.view)


def interaction_net(log: EventLog, resource: str = "resource") -> DataFrame:
    """(source, target, n, probability): who acts after whom; each case begins after the agent -1."""
    agent = F.col(resource).cast("string")
    w = log.in_case
    before = F.when(F.row_number().over(w) == 1, START).otherwise(F.lag(agent).over(w))
    rows = log.events.select(before.alias("source"), agent.alias("target")).groupBy("source", "target").agg(F.count("*").alias("n"))
    return rows.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


def agent_prefix_next(log: EventLog, longest: int = 5, resource: str = "resource") -> DataFrame:
    """(prefix, agent, next_activity, n, probability): what follows each run of at most `longest` activities
    whose last one was done by the agent."""
    w = log.in_case
    back = [F.lag("activity", k).over(w).alias(f"b{k}") for k in range(1, longest)]
    steps = log.events.select("activity", F.col(resource).alias("agent"), F.row_number().over(w).alias("pos"), F.lead("activity").over(w).alias("next_activity"), F.lead("seq").over(w).isNotNull().alias("goes_on"), *back)
    run = F.array(*(F.col(f"b{k}") for k in range(longest - 1, 0, -1)), F.col("activity"))
    lengths = F.sequence(F.lit(1), F.least(F.col("pos"), F.lit(longest)))
    rows = steps.where("goes_on").select("agent", "next_activity", run.alias("run"), F.explode(lengths).alias("k"))
    rows = rows.select(F.array_join(F.slice("run", longest - F.col("k") + 1, F.col("k")), "→").alias("prefix"), "agent", "next_activity")
    rows = rows.groupBy("prefix", "agent", "next_activity").agg(F.count("*").alias("n"))
    return rows.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prefix", "agent")), 6))


def weekday_runs(log: EventLog) -> DataFrame:
    """(weekday, runs, mean_cases, std_cases): lengths of runs of case starts on one weekday (Sunday = 0); the last run, still open, is left out.

    Starts are counted by day first, so the ordered window sees one row a day.
    """
    starts = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    days = starts.groupBy(F.to_date("start").alias("day")).agg(F.count("*").alias("n")).withColumn("weekday", F.dayofweek("day") - 1)
    w = Window.orderBy("day")
    opens = F.coalesce((F.lag("weekday").over(w) != F.col("weekday")).cast("int"), F.lit(1))
    days = days.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    runs = days.groupBy("run", "weekday").agg(F.sum("n").alias("n")).withColumn("last", F.max("run").over(Window.partitionBy()))
    closed = F.when(F.col("run") < F.col("last"), F.col("n"))
    return runs.groupBy("weekday").agg(F.count(closed).alias("runs"), F.round(F.avg(closed), 6).alias("mean_cases"), F.round(F.stddev_pop(closed), 6).alias("std_cases"))


def simulation_summary(real: EventLog, simulated: list[EventLog], resource: str = "resource") -> DataFrame:
    """One row: mean cases and events of the simulated logs; cases, events, activities and resources of the real one."""
    size = (F.count_distinct("case_id").alias("cases"), F.count("*").alias("events"))
    runs = reduce(DataFrame.union, (log.events.agg(*size) for log in simulated))
    means = runs.agg(F.round(F.avg("cases"), 6).alias("sim_cases"), F.round(F.avg("events"), 6).alias("sim_events"))
    whole = real.events.agg(*size, F.count_distinct("activity").alias("activities"), F.count_distinct(resource).alias("resources"))
    return whole.crossJoin(F.broadcast(means))


def representative(log: EventLog, activity: str, longest: int = 8) -> DataFrame:
    """(case_id, pos, activity, timestamp): the first events of the case in which the activity occurs earliest."""
    hit = log.events.where(F.col("activity") == activity).agg(F.min(F.struct("timestamp", "seq", "case_id")).alias("x")).select("x.case_id")
    rows = EventLog(log.events.join(F.broadcast(hit), "case_id"))
    return rows.sequenced().where(F.col("pos") <= longest).select("case_id", "pos", "activity", "timestamp")
