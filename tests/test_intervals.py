"""Concurrency, enabling events, availability, lanes and calendars against brute force."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import calendars, gaps, intervals, resources

START = datetime(2024, 1, 1)
SCHEMA = "case_id string, activity string, timestamp timestamp_ntz, end_timestamp timestamp_ntz, seq long, resource string"


def timed(spark, seed=1, n=240, days=6, longest=400):
    """Events of some cases and resources, with ties, instants and long ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = START + timedelta(minutes=10 * rng.randrange(days * 144))
        t = s + timedelta(minutes=10 * rng.choice([0, 0, 1, 2, 3, 6, 12, rng.randrange(longest // 10)]))
        rows.append((f"c{rng.randrange(9)}", rng.choice("abcd"), s, t, k, rng.choice(["r1", "r1", "r2", None])))
    return rows, EventLog(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_overlaps_are_counted_without_pairs(spark):
    rows, log = timed(spark)
    want: dict = {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1]:
                n, m = want.get((x[1], y[1]), (0, 0))
                want[x[1], y[1]] = n + 1, m + (x[2] < y[3] and y[2] < x[3])
    got = {(r["a"], r["b"]): (r["pairs"], r["overlapping"]) for r in intervals.overlap_counts(log).collect()}
    assert got == want and any(m for _, m in want.values())


def enabled(rows, apart):
    out = {}
    for e in rows:
        before = [p for p in rows if p[0] == e[0] and p[3] < e[3] and p[3] <= e[2] and p[1] not in apart.get(e[1], ())]
        best = max(before, key=lambda p: (p[3], -(p[2] - START).total_seconds(), -p[4]), default=None)
        out[e[4]] = (best[1], best[3]) if best else (None, None)
    return out


def test_enabling_leaves_out_concurrent_activities(spark):
    rows, log = timed(spark, 2)
    pairs = spark.createDataFrame([("a", "b"), ("c", "c"), ("d", "a")], "a string, b string")
    got = {r["seq"]: (r["enabled_by"], r["enabled_at"]) for r in intervals.enabling_nonconcurrent(log, pairs).collect()}
    assert got == enabled(rows, {"a": "bd", "b": "a", "c": "c", "d": "a"})
    assert intervals.enabling_nonconcurrent(EventLog(log.df.limit(0)), pairs).count() == 0


def first_and_last(b, e, taken, gap):
    """Walks points forward and backward until nothing occupies the resource for the length of a gap."""
    points = sorted([(x, 0) for x, _ in taken] + [(b, 0), (e, 0)] + [(y, 1) for _, y in taken] + [(b, 1), (e, 1)])
    active, first = 0, None
    for k, (at, kind) in enumerate(points):
        active += -1 if kind else 1
        if active == 0 and (k + 1 == len(points) or points[k + 1][0] - at >= gap):
            first = at
            break
    active = 0
    for k in range(len(points) - 1, 0, -1):
        at, kind = points[k]
        if at <= first:
            break
        active += 1 if kind else -1
        if active == 0 and at - points[k - 1][0] >= gap:
            return first, at
    return first, first


def off_duty(b, e, week):
    """Stretches of [b, e) outside a week's intervals (weekday, begin, end), day by day."""
    out, day = [], b.replace(hour=0, minute=0)
    while day < e:
        at = day
        for w, lo, hi in sorted(week):
            if w == day.isoweekday() % 7:
                out.append((at, day + timedelta(seconds=lo)))
                at = day + timedelta(seconds=hi)
        out.append((at, day + timedelta(days=1)))
        day += timedelta(days=1)
    return [(max(x, b), min(y, e)) for x, y in out if max(x, b) < min(y, e)]


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("gap_s", [1.0, 1800.0])
@pytest.mark.parametrize("on_duty", [False, True])
def test_availability_equals_a_walk_over_all_events(spark, seed, gap_s, on_duty):
    rows, log = timed(spark, seed, days=9, longest=4000)
    week = [(1, 28_800, 43_200), (1, 46_800, 61_200), (2, 0, 86_400), (3, 32_400, 54_000), (5, 32_400, 54_000)]
    calendar = spark.createDataFrame([("r1", *w) for w in week], "resource string, weekday int, begin_s int, end_s int") if on_duty else None
    none = spark.createDataFrame([], "a string, b string")
    got = {r["seq"]: (r["first_available"], r["last_available"]) for r in intervals.complex_delays(log, none, calendar, gap_s=gap_s).collect()}
    want = {}
    for e in rows:
        at = enabled(rows, {})[e[4]][1]
        if at is not None:
            own = [(o[2], o[3]) for o in rows if o[5] == e[5] and o[5] is not None and ((at < o[3] <= e[2]) or (at <= o[2] < e[2]))]
            own += off_duty(at, e[2], week) if on_duty and e[5] == "r1" else []
            want[e[4]] = first_and_last(at, e[2], own, timedelta(seconds=gap_s))
    assert got == want
    assert any(a != b for a, b in want.values())


def test_extrapolated_availability(spark):
    at = lambda h: START + timedelta(hours=h)
    waits = spark.createDataFrame([("c", 1, "r", at(0), at(10))], "case_id string, seq long, resource string, enabled_at timestamp_ntz, started_at timestamp_ntz")
    busy = spark.createDataFrame([("r", at(-1), at(2)), ("r", at(6), at(10))], "resource string, start timestamp_ntz, end timestamp_ntz")
    assert [tuple(r)[2:] for r in intervals.availability(waits, busy).collect()] == [(at(2), at(6))]
    assert [tuple(r)[2:] for r in intervals.availability(waits, busy, extrapolate=True).collect()] == [(at(1), at(8))]


def test_lanes(spark):
    rows, log = timed(spark, 5, n=300, days=4)
    for name in {r[5] for r in rows}:
        left, want, lane = sorted((r[3], r[2], r[4]) for r in rows if r[5] == name), {}, 1
        while left:
            rest, last = [], None
            for t, s, seq in left:
                if last is None or s >= last:
                    want[seq], last = lane, t
                else:
                    rest.append((t, s, seq))
            left, lane = rest, lane + 1
        got = {r["seq"]: r["lane"] for r in intervals.lanes(log).where(F.col("resource").eqNullSafe(name)).collect()}
        assert got == want
    solid = EventLog(log.df.where("end_timestamp > timestamp"))
    most = {r["resource"]: r["most"] for r in resources.concurrency(solid).collect()}
    assert {r["resource"]: r["n"] for r in intervals.lanes(solid, by="start").groupBy("resource").agg(F.max("lane").alias("n")).collect()} == most
    kept = {(r["resource"], r["lane"]): r["kept"] for r in intervals.disjoint_sets(log).collect()}
    assert all(kept[name, 1] for name, _ in kept)


def walked(week, a, b):
    """Working seconds of [a, b) by minutes."""
    total, at = 0, a
    while at < b:
        s = (at - at.replace(hour=0, minute=0)).total_seconds()
        total += 60 * any(w == at.isoweekday() % 7 and lo <= s < hi for w, lo, hi in week)
        at += timedelta(minutes=1)
    return total


WEEKS = {
    "days": [(1, 32_400, 43_200), (1, 46_800, 61_200), (3, 32_400, 61_200), (5, 0, 86_400), (6, 0, 3_600)],
    "wrap": [(6, 80_000 // 60 * 60, 86_400), (0, 0, 7_200)],
    "always": [(d, 0, 86_400) for d in range(7)],
    "overlapping": [(2, 3_600, 7_200), (2, 5_400, 10_800), (2, 10_800, 14_400)],
}


@pytest.mark.parametrize("name", WEEKS)
def test_calendar_algebra(spark, name):
    week, rng = WEEKS[name], random.Random(8)
    lit = calendars.week_literal(spark.createDataFrame(week, "weekday int, begin_s int, end_s int"))
    rows = []
    for k in range(40):
        a = datetime(1969, 12, 20) + timedelta(minutes=rng.randrange(30_000)) if k % 2 else datetime(2024, 2, 20) + timedelta(minutes=rng.randrange(15_000))
        rows.append((k, a, a + timedelta(minutes=rng.randrange(20_000))))
    df = spark.createDataFrame(rows, "k long, a timestamp_ntz, b timestamp_ntz").select("k", calendars.micros(F.col("a")).alias("a"), calendars.micros(F.col("b")).alias("b"))
    a, b, us = F.col("a"), F.col("b"), calendars.SECOND
    between = calendars.working_between(lit, a, b)
    got = df.select("k", between.alias("w"), calendars.instant(calendars.after(lit, a, between)).alias("back"), calendars.instant(calendars.opening(lit, a)).alias("opens")).collect()
    for r in got:
        _, x, y = rows[r["k"]]
        assert r["w"] == walked(week, x, y) * us
        if r["w"]:
            assert x < r["back"] <= y and walked(week, x, r["back"]) * us == r["w"] and walked(week, x, r["back"] - timedelta(minutes=1)) * us < r["w"]
        assert r["opens"] >= x and walked(week, r["opens"], r["opens"] + timedelta(minutes=1)) == 60 and walked(week, x, r["opens"]) == (0 if r["opens"] > x else 0)
    idle = calendars.idle_intervals(df, lit, "a", "b").select("k", calendars.instant(F.col("idle_start")).alias("s"), calendars.instant(F.col("idle_end")).alias("t")).collect()
    for k, x, y in rows:
        own = sorted((r["s"], r["t"]) for r in idle if r["k"] == k)
        assert sum((t - s).total_seconds() for s, t in own) == (y - x).total_seconds() - walked(week, x, y)
        assert all(walked(week, s, t) == 0 and x <= s < t <= y for s, t in own)
        assert all(t < s for (_, t), (s, _) in zip(own, own[1:], strict=False))


def test_calendar_without_working_time(spark):
    lit = calendars.week_literal(spark.createDataFrame([], "weekday int, begin_s int, end_s int"))
    row = spark.range(1).select(calendars.working_between(lit, F.lit(0), F.lit(10**12)).alias("w"), calendars.after(lit, F.lit(0), F.lit(5)).alias("a"), calendars.opening(lit, F.lit(0)).alias("o")).first()
    assert tuple(row) == (0, None, None)
    df = spark.range(1).select(F.lit(3).cast("long").alias("a"), F.lit(9).cast("long").alias("b"))
    assert [tuple(r)[2:] for r in calendars.idle_intervals(df, lit, "a", "b").collect()] == [(3, 9)]


def test_availability_does_not_pair_waits_with_intervals(spark):
    """One resource, one day: the plan joins nothing, and the result is that of a walk; background intervals and instants included."""
    rng = random.Random(11)
    at = lambda m: START + timedelta(minutes=m)
    taken = [("r", at(s := rng.randrange(1400)), at(s + rng.choice([0, 1, 2, 9, 700]))) for _ in range(250)] + [("r", at(-5000), at(5000)), ("r", at(30), at(1300))]
    waits = [("c", k, "r", at(b := rng.randrange(1300)), at(b + rng.randrange(140))) for k in range(400)] + [("c", 1000, "r", at(-9000), at(9000)), ("c", 1001, None, at(0), at(3)), ("c", 1002, None, at(0), at(0)), ("c", 1003, "q", at(0), at(3000))]
    w = spark.createDataFrame(waits, "case_id string, seq long, resource string, enabled_at timestamp_ntz, started_at timestamp_ntz")
    x = spark.createDataFrame(taken, "resource string, start timestamp_ntz, end timestamp_ntz")
    for gap in (0.0, 1.0, 300.0, 200_000.0):
        df = intervals.availability(w, x, gap_s=gap)
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = {r["seq"]: (r["first_available"], r["last_available"]) for r in df.collect()}
        for _, k, r, b, e in waits:
            own = sorted([(s, t) for o, s, t in taken if o == r and (b < t <= e or b <= s < e)] + [(b, b), (e, e)])
            reached, free = own[0][1], []
            for s, t in own[1:]:
                if s > reached and s - reached >= timedelta(seconds=gap):
                    free.append((reached, s))
                reached = max(reached, t)
            assert got[k] == ((free[0][0], free[-1][1]) if free else (reached, reached)), (gap, k)


def test_free_times_of_many_groups(monkeypatch):
    """Groups taken in turns give what they give at once."""
    rng = np.random.default_rng(12)
    n, m, day = 900, 600, 1000
    group, of = rng.integers(0, 40, n), np.sort(rng.integers(0, 40, m))
    days = rng.integers(0, 5, 40) * day
    s = days[group] + rng.integers(0, day, n)
    b = days[of] + rng.integers(0, day, m)
    rows = (group, days, s, s + rng.integers(0, 300, n), of, b, b + rng.integers(0, 2000, m), np.arange(0, 40, 3), days[::3] + 100, days[::3] + 200)
    want = gaps.free_times(*rows, 5, day)
    monkeypatch.setattr(gaps, "_MOST", 40_000)
    got = gaps.free_times(*rows, 5, day)
    assert all((got[k] == want[k]).all() for k in want)
    assert (want["first"] > 0).any() and (want["first"] < 0).any()


def test_availability_on_duty_joins_calendars_alone(spark):
    """Off-duty time comes by one join with resources; also where gaps are longer than a night, a day or a weekend."""
    rng = random.Random(13)
    week = [(1, 28_800, 43_200), (1, 46_800, 61_200), (2, 0, 86_400), (3, 32_400, 54_000), (5, 32_400, 54_000)]
    at = lambda m: START + timedelta(minutes=m)
    taken = [("r", at(s := rng.randrange(12_000)), at(s + rng.choice([0, 5, 60]))) for _ in range(40)] + [("r", at(-5000), at(30_000))]
    waits = [("c", k, "r", at(b := rng.randrange(9000)), at(b + rng.randrange(9000))) for k in range(150)]
    w = spark.createDataFrame(waits, "case_id string, seq long, resource string, enabled_at timestamp_ntz, started_at timestamp_ntz")
    x = spark.createDataFrame(taken, "resource string, start timestamp_ntz, end timestamp_ntz")
    off = intervals.off_duty(spark.createDataFrame([("r", *d) for d in week], "resource string, weekday int, begin_s int, end_s int"))
    found = dict.fromkeys((1.0, 3600.0, 20_000.0, 80_000.0, 100_000.0), 0)
    for gap in found:
        df = intervals.availability(w, x, off, gap_s=gap)
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "cw_r#" in line]
        assert len(joins) == 1
        got = {r["seq"]: (r["first_available"], r["last_available"]) for r in df.collect()}
        for _, k, _, b, e in waits:
            own = [(s, t) for _, s, t in taken if b < t <= e or b <= s < e] + off_duty(b, e, week)
            want = first_and_last(b, e, own, timedelta(seconds=gap))
            last = max([t for _, t in own] + [e])
            assert got[k] == want or (got[k] == (last, last) and want[0] == want[1]), (gap, k)
            found[gap] += want[0] != want[1]
    assert found[80_000.0] and not found[100_000.0]


def test_delays_join_events_by_key_alone(spark):
    """Waits meet no interval in a join: all joins but that of concurrent activities are by event."""
    _, log = timed(spark, 14)
    none = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = intervals.activity_timers(intervals.complex_delays(log, none))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("seq#" in line or "activity#" in line for line in joins)
    assert "day#" not in "".join(joins)


@pytest.mark.parametrize("deal, order", [(intervals._by_start, lambda x: x), (intervals._by_end, lambda x: x[::-1])])
def test_lanes_take_the_lowest_free_one(deal, order):
    """Against a look at all lanes, with ties, instants and more lanes at once than any power of two that was full before."""
    rng = random.Random(15)
    rows = sorted(((s := rng.randrange(400), s + rng.choice([0, 1, 5, 60, 300])) for _ in range(2500)), key=order)
    free, lane, found = [], deal(), []
    for s, t in rows:
        k = next((k for k, at in enumerate(free) if at <= s), len(free))
        free[k : k + 1] = [t]
        found.append(lane(s, t) == k + 1)
    assert all(found) and len(free) > 256


@pytest.mark.parametrize("deal", [intervals._by_start, intervals._by_end])
def test_lanes_of_many_events_at_once_take_time_in_proportion(deal):
    """50,000 events that all overlap: looking at each lane for each of them would be more than a thousand million steps."""
    lane, began = deal(), time.perf_counter()
    assert [lane(k, 10**6 + k) for k in range(50_000)] == list(range(1, 50_001))
    assert time.perf_counter() - began < 10
