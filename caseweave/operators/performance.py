"""Cycle times, sojourn times, bottlenecks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import half_even_bin, seconds_between
from caseweave.log import EventLog
from caseweave.operators.access import activity_frequency
from caseweave.operators.quantiles import described


def durations(log: EventLog) -> DataFrame:
    """(case_id, d): seconds from a case's first to last event."""
    per = log.events.groupBy("case_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return per.select("case_id", seconds_between(F.col("a"), F.col("b")).alias("d"))


def cycle_histogram(log: EventLog, bins: int = 50) -> DataFrame:
    """Cycle times in equal-width buckets, numbered by rounding half to even, the last one closed."""
    d = durations(log)
    bounds = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    rows = d.crossJoin(F.broadcast(bounds))
    bucket = half_even_bin(F.col("d"), F.col("lo"), F.col("hi"), bins)
    rows = rows.groupBy(bucket.alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return rows.select(
        "bucket",
        F.round(F.col("lo") + F.col("bucket") * width, 6).alias("bucket_start"),
        F.round(F.col("lo") + (F.col("bucket") + 1) * width, 6).alias("bucket_end"),
        "n",
    )


def log_histogram(values: DataFrame, column: str = "d", bins: int = 24) -> DataFrame:
    """Positive values in buckets of equal width on a logarithmic scale, empty ones included."""
    rows = values.where(F.col(column) > 0).select(F.col(column).alias("v"))
    bounds = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("lo").isNotNull())
    step = (F.ln("hi") - F.ln("lo")) / F.lit(float(bins))
    at = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.least(F.floor((F.ln("v") - F.ln("lo")) / step), F.lit(bins - 1)))
    found = rows.crossJoin(F.broadcast(bounds)).groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    n = F.when(F.col("hi") > F.col("lo"), bins).otherwise(1)
    frame = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), n - 1)).alias("bucket"))
    rows = frame.join(F.broadcast(found), "bucket", "left")
    return rows.select(
        "bucket",
        F.round(F.col("lo") * F.exp(F.col("bucket") * step), 3).alias("bucket_start"),
        F.round(F.col("lo") * F.exp((F.col("bucket") + 1) * step), 3).alias("bucket_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def activity_sojourn(log: EventLog) -> DataFrame:
    """Mean and p90 time to the next event of each activity; 0 where no event follows; frequency counts all events."""
    e = log.edges().where(F.col("seconds") >= 0)
    stats = described(e.withColumnRenamed("source", "activity"), "seconds", (0.9,), ("activity",)).select("activity", F.col("mean").alias("a"), F.col("q")[0].alias("p"))
    rows = activity_frequency(log).join(stats, "activity", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "activity", F.col("n").alias("frequency"), F.round(zero(F.col("a")), 6).alias("avg_sojourn_s"), F.round(zero(F.col("p")), 6).alias("p90_sojourn_s")
    )


def bottlenecks(log: EventLog, factor: float = 1.5) -> DataFrame:
    """Activities with their share of the total time, rank, and whether they are bottlenecks.

    A bottleneck's mean sojourn is positive and at least median + factor * IQR over
    the activities, or the median where the IQR is 0. Shares cover all activities.
    """
    rows = activity_sojourn(log)
    q = F.percentile("avg_sojourn_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    bounds = rows.agg(q.alias("q"), F.sum(F.col("avg_sojourn_s") * F.col("frequency")).alias("total"))
    iqr = F.col("q")[2] - F.col("q")[0]
    limit = F.when(iqr == 0, F.col("q")[1]).otherwise(F.col("q")[1] + factor * iqr)
    rows = rows.crossJoin(F.broadcast(bounds))
    share = F.when(F.col("total") > 0, F.col("avg_sojourn_s") * F.col("frequency") / F.col("total")).otherwise(0.0)
    rank = F.row_number().over(Window.orderBy(F.desc("avg_sojourn_s"), F.asc("activity")))
    return rows.select(
        "activity", "frequency", "avg_sojourn_s", "p90_sojourn_s",
        F.round(share, 6).alias("share_of_total_time"),
        ((F.col("avg_sojourn_s") > 0) & (F.col("avg_sojourn_s") >= limit)).alias("is_bottleneck"),
        rank.alias("rank"),
    )
