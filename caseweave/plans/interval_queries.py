"""Queries over events as intervals: concurrency, enabling events, availability during waits, lanes, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import calendars, intervals
from caseweave.plans.tables import table

#: Share of overlapping pairs from which activities count as concurrent in these queries.
RATIO = 0.002


def by_user_timed(spark: SparkSession, sf_dir: str) -> EventLog:
    """Events with the user as the case, ends 10 minutes to 10 hours after the starts, and seven resources that serve all cases."""
    rows = table(spark, sf_dir, "events")
    end = F.timestamp_add("MINUTE", (10 + F.col("event_id") % 50 * 12).cast("int"), F.col("ts"))
    rows = rows.withColumn("resource", F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string"))).withColumn("end_timestamp", end)
    return EventLog.from_table(rows, "user_id", "event_type", "ts", seq="event_id", resource="resource", end_timestamp="end_timestamp")


def _calendar(spark: SparkSession) -> DataFrame:
    """Monday to Friday, nine to five with a break, of a single calendar."""
    rows = [(d, a, b) for d in range(1, 6) for a, b in ((32_400, 43_200), (46_800, 61_200))]
    return spark.createDataFrame(rows, "weekday int, begin_s int, end_s int")


def _calendars(spark: SparkSession) -> DataFrame:
    """That calendar for r0 to r4; r5 and r6 have none."""
    return spark.createDataFrame([(f"r{k}",) for k in range(5)], "resource string").crossJoin(F.broadcast(_calendar(spark)))


def _concurrent(log: EventLog) -> DataFrame:
    return intervals.overlap_counts(log, RATIO).where("concurrent").select("a", "b")


def _delays(spark: SparkSession, d: str, calendar: bool = False) -> DataFrame:
    log = by_user_timed(spark, d)
    return intervals.complex_delays(log, _concurrent(log), _calendars(spark) if calendar else None)


def _working(spark: SparkSession, d: str) -> DataFrame:
    """Working seconds between each customer's first and last order."""
    week = calendars.week_literal(_calendar(spark))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    us = calendars.working_between(week, calendars.micros(F.col("a")), calendars.micros(F.col("b")))
    return rows.select("o_custkey", (us / 1e6).alias("working_s"))


def _idle(spark: SparkSession, d: str) -> DataFrame:
    """Stretches outside working time between the first and last order of each nation's customers."""
    week = calendars.week_literal(_calendar(spark))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_nationkey").agg(calendars.micros(F.min("o_orderdate")).alias("a"), calendars.micros(F.max("o_orderdate")).alias("b"))
    idle = calendars.idle_intervals(rows, week, "a", "b").groupBy("c_nationkey")
    length = (F.col("idle_end") - F.col("idle_start")) / 1e6
    return idle.agg(F.count("*").alias("n"), F.sum(length).alias("idle_s"), F.max(length).alias("longest_s"), F.max(calendars.instant(F.col("idle_end"))).alias("last_end"))


def _shift(spark: SparkSession, d: str) -> DataFrame:
    """Of each order: when work on it can begin, and when 400,000 working seconds more have passed."""
    week = calendars.week_literal(_calendar(spark))
    at = calendars.micros(F.col("o_orderdate")) + (F.col("o_orderkey") % 86_400) * calendars.SECOND
    return table(spark, d, "orders").select(
        "o_orderkey", calendars.instant(calendars.opening(week, at)).alias("opens"), calendars.instant(calendars.after(week, at, F.lit(400_000 * calendars.SECOND))).alias("done")
    )


QUERIES = {
    "overlap_counts": lambda s, d: intervals.overlap_counts(by_user_timed(s, d), RATIO),
    "enabling_nonconcurrent": lambda s, d: intervals.enabling_nonconcurrent(log := by_user_timed(s, d), _concurrent(log)),
    "availability": lambda s, d: _delays(s, d).select("case_id", "seq", "enabled_at", "first_available", "last_available", "delay_s"),
    "availability_calendar": lambda s, d: _delays(s, d, True).select("case_id", "seq", "enabled_at", "first_available", "last_available", "delay_s"),
    "delay_timers": lambda s, d: intervals.activity_timers(_delays(s, d)),
    "lane_counts": lambda s, d: intervals.lanes(by_user_timed(s, d), by="start").groupBy("resource").agg(F.max("lane").alias("lanes"), F.count("*").alias("events")),
    "disjoint_sets": lambda s, d: intervals.disjoint_sets(by_user_timed(s, d)),
    "busy_periods": lambda s, d: intervals.busy_periods(by_user_timed(s, d).events, "resource").groupBy("resource", "period").agg(F.count("*").alias("events"), F.max("end_timestamp").alias("until")),
    "calendar_working": _working,
    "calendar_idle": _idle,
    "calendar_shift": _shift,
}

_EV = (
    "ev AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts AS s, event_id AS seq, 'r' || CAST(event_id % 7 AS VARCHAR) AS resource, "
    "ts + to_minutes(CAST(10 + event_id % 50 * 12 AS INTEGER)) AS t FROM events WHERE ts IS NOT NULL)"
)
_OVERLAPS = (
    "pr AS (SELECT x.activity AS a, y.activity AS b, count(*) AS pairs, count(*) FILTER (x.s < y.t AND y.s < x.t) AS overlapping FROM ev x JOIN ev y ON x.case_id = y.case_id AND x.activity < y.activity GROUP BY ALL), "
    f"oc AS (SELECT *, overlapping >= {RATIO} * pairs AS concurrent FROM pr)"
)
_ENABLED = (
    "cc AS (SELECT a, b FROM oc WHERE concurrent UNION SELECT b, a FROM oc WHERE concurrent), "
    "en AS (SELECT e.case_id, e.seq, e.activity, e.resource, e.s, p.activity AS enabled_by, p.t AS enabled_at FROM ev e LEFT JOIN ev p ON e.case_id = p.case_id AND p.t < e.t AND p.t <= e.s "
    "AND NOT EXISTS (SELECT 1 FROM cc WHERE cc.a = e.activity AND cc.b = p.activity) QUALIFY row_number() OVER (PARTITION BY e.case_id, e.seq ORDER BY p.t DESC NULLS LAST, p.s, p.seq) = 1)"
)
_FREE = """iv AS ({intervals} UNION ALL SELECT case_id, seq, enabled_at, enabled_at FROM en WHERE enabled_at IS NOT NULL UNION ALL SELECT case_id, seq, s, s FROM en WHERE enabled_at IS NOT NULL),
gp AS (SELECT *, max(t) OVER (PARTITION BY case_id, seq ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv),
av AS (SELECT case_id, seq, coalesce(min(m) FILTER (s - m >= INTERVAL 1 SECOND), max(t)) AS first_available, coalesce(max(s) FILTER (s - m >= INTERVAL 1 SECOND), max(t)) AS last_available FROM gp GROUP BY ALL),
dl AS (SELECT en.*, first_available, last_available, (epoch_us(last_available) - epoch_us(first_available)) / 1000000.0::DOUBLE AS delay_s FROM en JOIN av USING (case_id, seq))"""
_BUSY = "SELECT e.case_id, e.seq, o.s, o.t FROM en e JOIN ev o USING (resource) WHERE (e.enabled_at < o.t AND o.t <= e.s) OR (e.enabled_at <= o.s AND o.s < e.s)"
#: Off-duty stretches of a week by weekday (Sunday = 0), day by day.
_OFF = (
    "of AS (SELECT * FROM (VALUES (0, 0, 86400), (6, 0, 86400)) v(wd, lo, hi) UNION ALL SELECT wd, lo, hi FROM (SELECT unnest([1, 2, 3, 4, 5]) AS wd) d, (VALUES (0, 32400), (43200, 46800), (61200, 86400)) v(lo, hi))"
)
_DUTY = (
    _BUSY + " UNION ALL SELECT case_id, seq, greatest(a, enabled_at), least(b, s) FROM (SELECT e.*, d + to_seconds(lo) AS a, d + to_seconds(hi) AS b FROM "
    "(SELECT *, unnest(generate_series(date_trunc('day', enabled_at), s, INTERVAL 1 DAY)) AS d FROM en WHERE enabled_at IS NOT NULL AND resource < 'r5') e JOIN of ON dayofweek(e.d) = wd) WHERE a < s AND b > enabled_at"
)
_DELAYS = f"WITH {_EV}, {_OVERLAPS}, {_ENABLED}, {_FREE.format(intervals=_BUSY)}"
_ON_DUTY = f"WITH {_EV}, {_OVERLAPS}, {_ENABLED}, {_OFF}, {_FREE.format(intervals=_DUTY)}"
_ROWS = "SELECT case_id, seq, enabled_at, first_available, last_available, delay_s FROM dl"
#: Working intervals of all days from a year before the first order to a year after the last.
_WORK = (
    "wk AS (SELECT d + to_seconds(lo) AS a, d + to_seconds(hi) AS b FROM (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)) - INTERVAL 1 YEAR, max(o_orderdate) + INTERVAL 1 YEAR, INTERVAL 1 DAY)) AS d FROM orders), "
    "(VALUES (32400, 43200), (46800, 61200)) v(lo, hi) WHERE dayofweek(d) BETWEEN 1 AND 5)"
)

ORACLE_SQL = {
    "overlap_counts": f"WITH {_EV}, {_OVERLAPS} SELECT * FROM oc",
    "enabling_nonconcurrent": f"WITH {_EV}, {_OVERLAPS}, {_ENABLED} SELECT case_id, seq, activity, enabled_by, enabled_at FROM en",
    "availability": f"{_DELAYS} {_ROWS}",
    "availability_calendar": f"{_ON_DUTY} {_ROWS}",
    "delay_timers": f"{_DELAYS} SELECT activity, count(*) AS n, round(avg(CASE WHEN delay_s > 0 THEN 1.0 ELSE 0.0 END), 6) AS delayed, round(avg(delay_s), 6) AS mean_delay_s FROM dl GROUP BY activity HAVING sum(delay_s) > 0",
    "lane_counts": f"""WITH {_EV}, m AS (SELECT resource, s AS p, 1 AS step FROM ev UNION ALL SELECT resource, t, -1 FROM ev), r AS (SELECT resource, sum(step) OVER (PARTITION BY resource ORDER BY p, step ROWS UNBOUNDED PRECEDING) AS n, step FROM m)
SELECT resource, CAST(max(n) AS INTEGER) AS lanes, count(*) FILTER (step = 1) AS events FROM r GROUP BY resource""",
    "busy_periods": f"""WITH {_EV}, r AS (SELECT *, max(t) OVER (PARTITION BY resource ORDER BY s, t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s >= m THEN 1 ELSE 0 END) OVER (PARTITION BY resource ORDER BY s, t, seq ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT resource, min(s) AS period, count(*) AS events, max(t) AS until FROM g GROUP BY resource, k""",
    "calendar_working": f"WITH {_WORK}, c AS (SELECT o_custkey, min(o_orderdate)::TIMESTAMP AS x, max(o_orderdate)::TIMESTAMP AS y FROM orders GROUP BY 1), u AS (SELECT DISTINCT x AS p FROM c UNION SELECT DISTINCT y FROM c), "
    "w AS (SELECT p, coalesce(sum(epoch_us(least(b, p)) - epoch_us(a)), 0) / 1000000.0::DOUBLE AS w FROM u LEFT JOIN wk ON a < p GROUP BY p) "
    "SELECT o_custkey, wy.w - wx.w AS working_s FROM c JOIN w wx ON wx.p = x JOIN w wy ON wy.p = y",
    "calendar_idle": f"""WITH {_WORK}, gp AS (SELECT b AS lo, lead(a) OVER (ORDER BY a) AS hi FROM wk), c AS (SELECT c_nationkey, min(o_orderdate)::TIMESTAMP AS x, max(o_orderdate)::TIMESTAMP AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
i AS (SELECT c_nationkey, greatest(lo, x) AS lo, least(hi, y) AS hi FROM c JOIN gp ON lo < y AND hi > x AND lo < hi)
SELECT c_nationkey, count(*) AS n, sum((epoch_us(hi) - epoch_us(lo)) / 1000000.0::DOUBLE) AS idle_s, max((epoch_us(hi) - epoch_us(lo)) / 1000000.0::DOUBLE) AS longest_s, max(hi) AS last_end FROM i WHERE lo < hi GROUP BY 1""",
    "calendar_shift": f"""WITH {_WORK}, cu AS (SELECT *, sum(epoch_us(b) - epoch_us(a)) OVER (ORDER BY a) AS upto, epoch_us(b) - epoch_us(a) AS len FROM wk), o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS p FROM orders),
n AS (SELECT o_orderkey, greatest(a, p) AS opens, upto - len + greatest(0, epoch_us(p) - epoch_us(a)) + 400000000000 AS target FROM o ASOF JOIN cu ON o.p < cu.b)
SELECT o_orderkey, opens, a + to_microseconds(CAST(target - (upto - len) AS BIGINT)) AS done FROM n ASOF JOIN cu ON n.target <= cu.upto""",
}
