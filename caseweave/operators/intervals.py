"""Events as intervals: what a resource was doing during a wait, what enabled an event, lanes of overlapping events.

Where a resource or a case may hold a large share of all events, its time is cut: running values
are formed within a day and carried over from day to day through one row a day, and groups that are
swept end at instants at which the resource is idle. Sweeps in tasks read their
rows in order and keep only a map by activity, or the lanes that are open.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.log import EventLog
from caseweave.operators import gaps
from caseweave.operators.calendars import SECOND, instant, micros

DAY = 86_400 * SECOND


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns; null keys meet."""
    right = right.withColumnsRenamed({k: f"cw_key_{k}" for k in keys})
    return left.join(right, reduce(and_, (F.col(k).eqNullSafe(F.col(f"cw_key_{k}")) for k in keys)), "left").drop(*(f"cw_key_{k}" for k in keys))


def running(rows: DataFrame, by: str, time: Column, order: list[str], value: Column, how: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str, own: bool = False) -> DataFrame:
    """rows with `name`: how (max, sum, ...) of value over the rows of one `by` that come before in order (own: and the row itself).

    order begins with the time. Rows are ordered within a day; the days before come in as one row a day.
    """
    rows = rows.withColumn("cw_day", F.date_trunc("day", time)).withColumn("cw_value", value)
    days = rows.groupBy(by, "cw_day").agg(how(F.col("cw_value")).alias("cw_all"))
    earlier = how(F.col("cw_all")).over(Window.partitionBy(by).orderBy("cw_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(by, "cw_day", earlier.alias("cw_earlier"))
    today = Window.partitionBy(by, "cw_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rows = _met(rows.withColumn("cw_today", how(F.col("cw_value")).over(today)), days, [by, "cw_day"])
    return rows.withColumn(name, join(F.col("cw_earlier"), F.col("cw_today"))).drop("cw_day", "cw_value", "cw_today", "cw_earlier")


def running_max(rows: DataFrame, by: str, time: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the largest value among earlier rows of one `by`; null for the first."""
    return running(rows, by, time, order, value, F.max, F.greatest, name)


def busy_periods(events: DataFrame, by: str, start: str = "timestamp", end: str = "end_timestamp") -> DataFrame:
    """events with period, the start of the stretch without an idle instant in which the event lies, by resource (or another column)."""
    key = [start, end, "seq"]
    rows = running_max(events, by, F.col(start), key, F.col(end), "cw_reached")
    opens = F.when(F.coalesce(F.col(start) >= F.col("cw_reached"), F.lit(True)), F.col(start))
    last = lambda x: F.last(x, ignorenulls=True)
    rows = running(rows, by, F.col(start), key, opens, last, lambda earlier, today: F.coalesce(today, earlier), "period", own=True)
    return rows.drop("cw_reached")


def _swept(rows: DataFrame, keys: list[str], order: list[str], step: Callable, schema: T.StructType) -> DataFrame:
    """Rows dealt by keys and read in order; step(batch columns, fresh) yields output rows, fresh marks the first row of each key."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, known = step(), object()
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[: len(keys)]
                if key != known:
                    sweep, known = step(), key
                out.extend(sweep(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.from_numpy_dtype("int64") if isinstance(f.dataType, T.LongType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for k, f in enumerate(schema)],
                names=schema.names,
            )

    dealt = rows.select(*keys, *(c for c in columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def _intervals(log: EventLog, end: str) -> DataFrame:
    return log.events.where(F.col(end) >= F.col("timestamp")).select("case_id", F.col("seq").cast("long").alias("seq"), "activity", micros(F.col("timestamp")).alias("s"), micros(F.col(end)).alias("t"))


def overlap_counts(log: EventLog, ratio: float = 0.9, end: str = "end_timestamp") -> DataFrame:
    """(a, b, pairs, overlapping, concurrent) for a < b: pairs of events of two activities in one case, and how many of them overlap.

    Concurrent if the overlapping ones reach `ratio` of all. Overlapping pairs are counted when the later
    one starts, from the number of running events by activity, so events are never paired.
    """
    e = _intervals(log, end)
    marks = F.array(
        F.struct(F.col("t").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("s").alias("at"), F.when(F.col("s") == F.col("t"), 1).otherwise(2).alias("kind"))
    )
    rows = e.select("case_id", "activity", F.explode(F.filter(marks, lambda m: (m["kind"] > 0) | (F.col("s") < F.col("t")))).alias("m")).select("case_id", "m.at", "m.kind", "activity")

    def step():
        active: dict[str, int] = {}

        def sweep(row):
            _, _, kind, activity = row
            if kind == 0:
                active[activity] -= 1
                return ()
            found = [(min(activity, b), max(activity, b), n) for b, n in active.items() if n and b != activity]
            if kind == 2:
                active[activity] = active.get(activity, 0) + 1
            return found

        return sweep

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])
    met = _swept(rows, ["case_id"], ["at", "kind"], step, schema).groupBy("a", "b").agg(F.sum("n").alias("overlapping"))
    per = e.groupBy("case_id", "activity").agg(F.count("*").alias("n"))
    sides = per.groupBy("case_id").agg(F.collect_list(F.struct("activity", "n")).alias("x"))
    both = sides.select("x", F.explode("x").alias("p")).select("p", F.explode("x").alias("q")).where("p.activity < q.activity")
    pairs = both.groupBy(F.col("p.activity").alias("a"), F.col("q.activity").alias("b")).agg(F.sum(F.col("p.n") * F.col("q.n")).alias("pairs"))
    found = pairs.join(met, ["a", "b"], "left").select("a", "b", "pairs", F.coalesce("overlapping", F.lit(0)).cast("long").alias("overlapping"))
    return found.withColumn("concurrent", F.col("overlapping") >= ratio * F.col("pairs"))


def enabling_nonconcurrent(log: EventLog, concurrent: DataFrame, end: str = "end_timestamp") -> DataFrame:
    """(case_id, seq, activity, enabled_by, enabled_at): the event of the case that ended last by an event's start, leaving out activities concurrent with its own.

    concurrent has pairs (a, b), in either direction. Of events that ended at one instant the one that started
    first counts, then the smallest seq; an event without duration is not enabled by what ended at its own
    instant. One sweep over a case keeps the latest end of each activity.
    """
    e = _intervals(log, end)
    both = concurrent.select("a", "b").union(concurrent.select("b", "a")).groupBy("a").agg(F.array_join(F.array_sort(F.collect_set("b")), "\x1f").alias("apart"))
    e = e.join(both.withColumnRenamed("a", "activity"), "activity", "left")
    mark = lambda at, kind: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"))
    marks = F.array(mark("t", 1), F.when(F.col("s") == F.col("t"), mark("s", 0)).otherwise(mark("s", 2)))
    rows = e.select("case_id", F.explode(marks).alias("m"), "seq", "activity", "s", "t", "apart").select("case_id", "m.at", "m.kind", "seq", "activity", "s", "t", "apart")

    def step():
        ended: dict[str, tuple[int, int, int]] = {}

        def sweep(row):
            case, _, kind, seq, activity, s, t, apart = row
            if kind == 1:
                ended[activity] = max(ended.get(activity, (t, -s, -seq)), (t, -s, -seq))
                return ()
            out = set(apart.split("\x1f")) if apart is not None else ()
            best = max(((mark, b) for b, mark in ended.items() if b not in out), default=None)
            return ((case, seq, activity, best[1] if best else None, best[0][0] if best else None),)

        return sweep

    schema = T.StructType([T.StructField(c, k) for c, k in (("case_id", T.StringType()), ("seq", T.LongType()), ("activity", T.StringType()), ("enabled_by", T.StringType()), ("at", T.LongType()))])
    found = _swept(rows, ["case_id"], ["at", "kind", "seq"], step, schema)
    return found.select("case_id", "seq", "activity", "enabled_by", instant(F.col("at")).alias("enabled_at"))


def lanes(log: EventLog, resource: str = "resource", end: str = "end_timestamp", by: str = "end") -> DataFrame:
    """(case_id, seq, resource, lane): events of a resource dealt to lanes (from 1) in which none overlap, each to the first that is free.

    Taken in order of their ends, lane 1 is a largest set of disjoint events, lane 2 one of the rest, and so on;
    by="start" takes them in order of their starts, which needs as many lanes as events run at once. At an
    idle instant all lanes are free, so a resource's busy periods are dealt apart.
    """
    rows = log.events.where(F.col(end) >= F.col("timestamp")).withColumnRenamed(resource, "cw_resource") if resource != "resource" else log.events.where(F.col(end) >= F.col("timestamp")).withColumnRenamed("resource", "cw_resource")
    rows = busy_periods(rows, "cw_resource", "timestamp", end)
    rows = rows.select("cw_resource", micros(F.col("period")).alias("period"), micros(F.col("timestamp")).alias("s"), micros(F.col(end)).alias("t"), F.col("seq").cast("long").alias("seq"), "case_id")
    order = ["t", "s", "seq"] if by == "end" else ["s", "t", "seq"]
    deal = _by_end if by == "end" else _by_start
    schema = T.StructType([rows.schema["case_id"], T.StructField("seq", T.LongType()), T.StructField("resource", rows.schema["cw_resource"].dataType), T.StructField("lane", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, known = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            name, period, s, t = (batch[c] for c in ("cw_resource", "period", "s", "t"))
            new = [name[0].as_py() != known[0] or period[0].as_py() != known[1]] if known else [True]
            null = name.is_null()
            other = pc.fill_null(pc.or_(pc.not_equal(null[1:], null[:-1]), pc.or_(pc.fill_null(pc.not_equal(name[1:], name[:-1]), False), pc.not_equal(period[1:], period[:-1]))), True)
            new += other.to_pylist()
            out = []
            for fresh, x, y in zip(new, s.to_pylist(), t.to_pylist(), strict=True):
                if fresh:
                    lane = deal()
                out.append(lane(x, y))
            known = (name[-1].as_py(), period[-1].as_py())
            yield pa.RecordBatch.from_arrays([batch["case_id"], batch["seq"], name, pa.array(out, pa.int32())], names=schema.names)

    dealt = rows.repartition("cw_resource", "period").sortWithinPartitions("cw_resource", "period", *order)
    return dealt.mapInArrow(run, schema)


def _by_start() -> Callable[[int, int], int]:
    """Lanes for intervals in order of their starts: each call gives the lowest lane that is free. A lane once free stays so until it is taken."""
    taken: list[tuple[int, int]] = []
    free: list[int] = []
    n = 0

    def lane(s: int, t: int) -> int:
        nonlocal n
        while taken and taken[0][0] <= s:
            heapq.heappush(free, heapq.heappop(taken)[1])
        if free:
            k = heapq.heappop(free)
        else:
            k = n = n + 1
        heapq.heappush(taken, (t, k))
        return k

    return lane


def _by_end() -> Callable[[int, int], int]:
    """Lanes for intervals in order of their ends: each call gives the lowest lane whose last interval ended by the start.

    Lanes are the leaves of a tree of least ends, which doubles when it is full; a lane without intervals is free from ever.
    """
    never = float("-inf")
    size, least = 1, [never, never]

    def lane(s: int, t: int) -> int:
        nonlocal size, least
        if least[1] > s:
            # All are taken: the tree so far becomes the left half of one of twice the size.
            more = [never] * (4 * size)
            at = 1
            while at <= size:
                more[2 * at : 3 * at] = least[at : 2 * at]
                at *= 2
            size, least = 2 * size, more
        k = 1
        while k < size:
            k *= 2
            if least[k] > s:
                k += 1
        least[k] = t
        found = k - size + 1
        while k > 1:
            k >>= 1
            a, b = least[2 * k], least[2 * k + 1]
            least[k] = a if a < b else b
        return found

    return lane


def disjoint_sets(log: EventLog, resource: str = "resource", end: str = "end_timestamp") -> DataFrame:
    """(resource, lane, events, kept): the sizes of the sets of disjoint events; those before the first set of a single event are kept, and a resource's only event."""
    sizes = lanes(log, resource, end).groupBy("resource", "lane").agg(F.count("*").alias("events"))
    whole = Window.partitionBy("resource")
    ends = F.min(F.when(F.col("events") == 1, F.col("lane"))).over(whole)
    kept = F.coalesce(F.col("lane") < ends, F.lit(True)) | (F.sum("events").over(whole) == 1)
    return sizes.withColumn("kept", kept)


def _day_gaps(rows: DataFrame, gap: int) -> DataFrame:
    """(case_id, seq, first, lo, hi, end, z) of each wait's day: `gaps.free_times`.

    rows is (r, day, wait, case_id, seq, b, e, rest): waits and intervals on days of resources; rest holds the bounds of a day's
    off-duty stretches, one after another. A task keeps the rows of some days at a time, a single one's at least.
    """
    names = ("first", "lo", "hi", "end", "z")
    types = rows.schema
    schema = T.StructType([types["case_id"], types["seq"], *(T.StructField(c, T.LongType()) for c in names)])

    def starts(table: pa.Table) -> np.ndarray:
        """Whether a row is the first of its resource and day."""
        r, day = table["r"].combine_chunks(), table["day"].to_numpy()
        return np.append(True, pc.not_equal(r[1:], r[:-1]).to_numpy(zero_copy_only=False) | (day[1:] != day[:-1]))

    def found(table: pa.Table) -> pa.RecordBatch:
        new, wait = starts(table), table["wait"].to_numpy()
        group, b, e = np.cumsum(new) - 1, table["b"].to_numpy(), table["e"].to_numpy()
        day = table["day"].to_numpy()[new] * DAY
        of, first = np.unique(group[wait], return_index=True)
        rest = table["rest"].take(pa.array(np.flatnonzero(wait)[first])).to_pylist()
        off = np.array([(g, day[g] + p[k], day[g] + p[k + 1]) for g, p in zip(of, rest, strict=True) if p for k in range(0, len(p), 2)], np.int64).reshape(-1, 3)
        out = gaps.free_times(group[~wait], day, b[~wait], e[~wait], group[wait], b[wait], e[wait], off[:, 0], off[:, 1], off[:, 2], gap, DAY)
        keys = table.select(["case_id", "seq"]).filter(pa.array(wait)).combine_chunks()
        columns = [keys[c].combine_chunks() if keys[c].num_chunks else pa.array([], keys[c].type) for c in keys.column_names]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(out[c], mask=out[c] == np.iinfo(np.int64).min) for c in names)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 1 << 17
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                table = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(starts(table))[-1])
                if cut:
                    yield found(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
                most = max(1 << 17, 2 * n)
        if n:
            yield found(pa.Table.from_batches(held))

    return rows.repartition("r", "day").sortWithinPartitions("r", "day").mapInArrow(run, schema)


def availability(waits: DataFrame, busy: DataFrame, off: DataFrame | None = None, gap_s: float = 1.0, extrapolate: bool = False) -> DataFrame:
    """(case_id, seq, first_available, last_available): when a resource was first and last free during a wait.

    waits is (case_id, seq, resource, enabled_at, started_at), busy (resource, start, end), off, if any,
    (resource, weekday, begin_s, end_s) with Sunday = 0: when a resource is off duty. A resource is
    occupied by its intervals that end within (enabled_at, started_at] or start within [enabled_at,
    started_at), and by off-duty time. It is free for stretches of at least gap_s between these; first is where the
    first such stretch begins, last where the last one ends. Without one both are where all that
    occupies it ends. extrapolate moves both half-way to the ends of the wait.

    Days deal a resource into many groups: intervals and waits go to the days they meet, where free stretches
    are found by searches in order of time (`gaps`), so waits are not paired with intervals.
    """
    gap = max(int(gap_s * SECOND), 1)
    w = waits.where(F.col("enabled_at").isNotNull()).select("case_id", "seq", F.col("resource").alias("r"), micros(F.col("enabled_at")).alias("b"), micros(F.col("started_at")).alias("e")).where("b <= e")
    day = lambda c: F.call_function("div", c - F.pmod(c, F.lit(DAY)), F.lit(DAY))
    x = busy.where(F.col("resource").isNotNull()).select(F.col("resource").alias("r"), micros(F.col("start")).alias("b"), micros(F.col("end")).alias("e")).where("b <= e")
    x = x.withColumn("day", F.explode(F.sequence(day(F.col("b")), day(F.col("e") + gap))))
    days = w.withColumn("day", F.explode(F.sequence(day(F.col("b")), day(F.col("e")))))
    # Off-duty stretches that reach into a day, or end less than gap before it; in microseconds from its midnight.
    rest = F.lit(None).cast("array<bigint>")
    if off is not None:
        us = lambda c: F.col(c).cast("long") * SECOND
        rows = off.select(F.col("resource").alias("cw_r"), F.struct(F.pmod(F.col("weekday").cast("long"), F.lit(7)).alias("weekday"), us("begin_s").alias("lo"), us("end_s").alias("hi")).alias("p"))
        days = days.join(rows.groupBy("cw_r").agg(F.collect_list("p").alias("week")), F.col("r") == F.col("cw_r"), "left")
        on = lambda k: F.filter("week", lambda p: (p["weekday"] == F.pmod(F.col("day") - k, F.lit(7))) & (p["lo"] < p["hi"]) & (p["hi"] - k * DAY > -gap))
        rest = F.flatten(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(-(-gap // DAY)).cast("long")), lambda k: F.transform(on(k), lambda p: F.array(p["lo"] - k * DAY, p["hi"] - k * DAY)))))
    # Null resources have no intervals.
    days = days.select(F.coalesce(F.concat(F.lit("r"), F.col("r").cast("string")), F.concat(F.lit("c"), F.col("case_id").cast("string")), F.lit("")).alias("r"), "day", "case_id", "seq", "b", "e", rest.alias("rest"))
    none = [F.lit(None).cast(days.schema[c].dataType).alias(c) for c in ("case_id", "seq")]
    x = x.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("r"), "day", *none, "b", "e", F.lit(None).cast("array<bigint>").alias("rest"))
    rows = days.withColumn("wait", F.lit(True)).unionByName(x.withColumn("wait", F.lit(False)))
    parts = _day_gaps(rows, gap).groupBy("case_id", "seq")
    parts = parts.agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "lo"))).alias("f"), F.max("hi").alias("hi"), F.max("end").alias("end"), F.collect_list("z").alias("z"))
    # What ended on the days before the first free stretch's end may have ended last before it.
    lo = F.greatest(F.col("f.lo"), F.array_max(F.filter("z", lambda z: z < F.col("f.first"))))
    found = parts.select("case_id", "seq", F.coalesce(lo, "end").alias("lo"), F.coalesce("hi", "end").alias("hi"))
    if extrapolate:
        found = found.join(w.select("case_id", "seq", "b", "e"), ["case_id", "seq"])
        both = (F.col("lo") != F.col("e")) & (F.col("hi") != F.col("e"))
        half = lambda c: F.call_function("div", c, F.lit(2))
        lo, hi = F.col("lo") - half(F.col("lo") - F.col("b")), F.col("hi") + half(F.col("e") - F.col("hi"))
        found = found.select("case_id", "seq", F.when(both, lo).otherwise(F.col("lo")).alias("lo"), F.when(both, hi).otherwise(F.col("hi")).alias("hi"))
    return found.select("case_id", "seq", instant(F.col("lo")).alias("first_available"), instant(F.col("hi")).alias("last_available"))


def off_duty(calendar: DataFrame) -> DataFrame:
    """(resource, weekday, begin_s, end_s) outside the working intervals of calendar (same columns), day by day, all days of every resource in it."""
    days = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")
    every = calendar.select("resource").distinct().select("resource", days)
    given = calendar.select("resource", F.col("weekday").cast("int").alias("weekday"), F.struct(F.col("begin_s").cast("long").alias("lo"), F.col("end_s").cast("long").alias("hi")).alias("p"))
    held = given.groupBy("resource", "weekday").agg(F.array_sort(F.collect_list("p")).alias("p"))
    rows = _met(every, held, ["resource", "weekday"])
    lo, full = F.lit(0).cast("long"), F.lit(86_400).cast("long")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    # Walks the sorted intervals; state is how far the day is worked or listed, and what was listed.
    start = F.struct(lo.alias("at"), none.alias("out"))

    def step(state: Column, p: Column) -> Column:
        listed = F.when(p["lo"] > state["at"], F.concat(state["out"], F.array(F.struct(state["at"].alias("lo"), p["lo"].alias("hi"))))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], p["hi"]).alias("at"), listed.alias("out"))

    def close(state: Column) -> Column:
        return F.when(state["at"] < full, F.concat(state["out"], F.array(F.struct(state["at"].alias("lo"), full.alias("hi"))))).otherwise(state["out"])

    gaps = F.aggregate(F.coalesce("p", none), start, step, close)
    return rows.select("resource", "weekday", F.explode(gaps).alias("g")).select("resource", "weekday", F.col("g.lo").alias("begin_s"), F.col("g.hi").alias("end_s"))


def complex_delays(log: EventLog, concurrent: DataFrame | None = None, calendar: DataFrame | None = None, resource: str = "resource", end: str = "end_timestamp", gap_s: float = 1.0, extrapolate: bool = False) -> DataFrame:
    """(case_id, seq, activity, enabled_by, enabled_at, first_available, last_available, delay_s) of every event that another one enabled.

    The delay lies between the instants at which the resource was first and last free while the event
    waited. concurrent defaults to `overlap_counts` at its ratio; calendar is (resource, weekday,
    begin_s, end_s), and a resource without one is always on duty.
    """
    if concurrent is None:
        concurrent = overlap_counts(log, end=end).where("concurrent").select("a", "b")
    enabled = enabling_nonconcurrent(log, concurrent, end).where(F.col("enabled_at").isNotNull())
    own = log.events.select("case_id", F.col("seq").cast("long").alias("seq"), F.col(resource).alias("resource"), F.col("timestamp").alias("started_at"))
    busy = log.events.select(F.col(resource).alias("resource"), F.col("timestamp").alias("start"), F.col(end).alias("end"))
    free = availability(enabled.join(own, ["case_id", "seq"]), busy, None if calendar is None else off_duty(calendar), gap_s, extrapolate)
    rows = enabled.join(free, ["case_id", "seq"])
    return rows.withColumn("delay_s", F.timestamp_diff("MICROSECOND", F.col("first_available"), F.col("last_available")) / 1e6)


def activity_timers(delays: DataFrame, by: str = "activity") -> DataFrame:
    """(by, n, delayed, mean_delay_s): delays by activity, or by enabling activity for timers placed after; only where any event is delayed."""
    rows = delays.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("delay_s") > 0).cast("double")), 6).alias("delayed"), F.round(F.avg("delay_s"), 6).alias("mean_delay_s"), F.sum("delay_s").alias("all"))
    return rows.where("all > 0").drop("all")
