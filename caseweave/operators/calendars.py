"""Weekly calendars as functions of time: working time passed, its inverse, openings, idle intervals.

A week is an array of disjoint working intervals in microseconds from Sunday's midnight, each
with the working time before it. Working time up to an instant is whole weeks times a
week's total plus a sum over the week's intervals, so its cost does not depend on how
far two instants lie apart, and no row is made for a day. All functions are column expressions; a
week may be a literal, or a column that differs by resource.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
WEEK = 7 * 86_400 * SECOND
#: A Sunday.
ORIGIN = "1970-01-04 00:00:00"


def micros(at: Column) -> Column:
    """Microseconds from a Sunday's midnight, as a long; exact, and free of time zones."""
    return F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def instant(us: Column) -> Column:
    """The inverse of `micros`."""
    return F.timestamp_add("MICROSECOND", us, F.lit(ORIGIN).cast("timestamp_ntz"))


def weeks(calendar: DataFrame, *by: str) -> DataFrame:
    """(by, week array<struct<lo, hi, before>>): calendars (by, weekday, begin_s, end_s) with Sunday = 0, overlapping and touching intervals joined."""
    at = lambda c: (F.col("weekday") * 86_400 + F.col(c)).cast("long") * SECOND
    rows = calendar.select(*by, at("begin_s").alias("lo"), at("end_s").alias("hi")).where("lo < hi")
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.coalesce((F.col("lo") > reached).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy(*by).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.struct("lo", "hi", before.cast("long").alias("before"))
    return runs.select(*by, part.alias("part")).groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("week"))


def week_literal(calendar: DataFrame) -> Column:
    """The week of one calendar, of at most a week of minutes, as a literal."""
    rows = weeks(calendar).select(F.explode("week").alias("p")).select("p.*").orderBy("lo").limit(7 * 1_440 + 1).collect()
    if len(rows) > 7 * 1_440:
        raise ValueError("a week has no more than an interval a minute")
    parts = [F.struct(F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi"), F.lit(r["before"]).alias("before")) for r in rows]
    return F.array(*parts).cast("array<struct<lo:bigint,hi:bigint,before:bigint>>")


def _total(week: Column) -> Column:
    last = F.get(week, F.size(week) - 1)
    return F.coalesce(last["before"] + last["hi"] - last["lo"], F.lit(0).cast("long"))


def _split(us: Column) -> tuple[Column, Column]:
    """Number of the week, and microseconds into it."""
    into = F.pmod(us, F.lit(WEEK))
    return _div(us - into, F.lit(WEEK)), into


def _div(a: Column, b: Column) -> Column:
    """Whole-number division without a detour through doubles."""
    return F.call_function("div", a, b)


def worked(week: Column, at: Column) -> Column:
    """Working microseconds from the origin to an instant (microseconds), negative before it."""
    number, into = _split(at)
    inside = F.aggregate(week, F.lit(0).cast("long"), lambda s, p: s + F.greatest(F.least(into, p["hi"]) - p["lo"], F.lit(0).cast("long")))
    return number * _total(week) + inside


def working_between(week: Column, start: Column, end: Column) -> Column:
    """Working microseconds in [start, end)."""
    return worked(week, end) - worked(week, start)


def after(week: Column, start: Column, amount: Column) -> Column:
    """The instant at which `amount` working microseconds have passed since start: the first such. Null where the week has no working time."""
    total = F.nullif(_total(week), F.lit(0).cast("long"))
    target = worked(week, start) + amount
    rest = F.pmod(target - 1, total) + 1
    number = _div(target - rest, total)
    part = F.get(F.filter(week, lambda p: rest <= p["before"] + p["hi"] - p["lo"]), F.lit(0))
    return F.when(amount > 0, number * WEEK + part["lo"] + rest - part["before"]).when(amount == 0, start)


def opening(week: Column, at: Column) -> Column:
    """The instant itself within working time, else when the next interval begins. Null where there is none."""
    number, into = _split(at)
    part = F.get(F.filter(week, lambda p: p["hi"] > into), F.lit(0))
    first = F.get(week, F.lit(0))["lo"] + (number + 1) * WEEK
    return F.coalesce(number * WEEK + F.when(part.isNotNull(), F.greatest(part["lo"], into)), first)


def idle_intervals(rows: DataFrame, week: Column, start: str, end: str) -> DataFrame:
    """rows with idle_start and idle_end (microseconds), one row for each stretch of [start, end) outside working time.

    Working intervals are numbered through all weeks, so the stretches of a row are a range of numbers.
    """
    a, b, k = F.col(start), F.col(end), F.size(week)
    number_a, into_a = _split(a)
    number_b, into_b = _split(b)
    first = number_a * k + F.size(F.filter(week, lambda p: p["lo"] <= into_a))
    last = number_b * k + F.size(F.filter(week, lambda p: p["hi"] < into_b))
    numbers = F.when(k == 0, F.array(F.lit(0).cast("long"))).when(first <= last, F.sequence(first, last))
    gaps = rows.withColumn("cw_j", F.explode(numbers))
    j = F.col("cw_j")
    part = lambda n: F.get(week, F.pmod(n, F.nullif(k, F.lit(0))).cast("int"))
    base = lambda n: _div(n - F.pmod(n, F.nullif(k, F.lit(0))), F.nullif(k, F.lit(0))) * WEEK
    lo = F.greatest(a, base(j - 1) + part(j - 1)["hi"])
    hi = F.least(b, base(j) + part(j)["lo"])
    return gaps.withColumn("idle_start", lo).withColumn("idle_end", hi).drop("cw_j").where("idle_start < idle_end")
