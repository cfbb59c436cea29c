"""Discovery of what a simulation of a log needs: orders, waits, hand-overs, calendars, distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import seconds_between, time_ranked
from caseweave.log import EventLog
from caseweave.operators import graphs, intervals


def split_by_time(log: EventLog, test_share: float = 0.2, end: str = "timestamp") -> DataFrame:
    """Events with `part`: train (earliest), test, or cut for cases that lie on both sides."""
    side = F.when(F.col("rank") <= F.round(F.col("total") * (1 - test_share)), "train").otherwise("test")
    rows = time_ranked(log.events, end, "case_id", "seq").withColumn("side", side).drop("rank", "total")
    sides = rows.groupBy("case_id").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    rows = rows.join(sides, "case_id")
    return rows.withColumn("part", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("cut")).drop("side", "lo", "hi")


def validation_cases(log: EventLog, share: float = 0.2) -> DataFrame:
    """The last share of case ids."""
    ids = log.events.select("case_id").distinct()
    rank, n = F.row_number().over(Window.orderBy("case_id")), F.count("*").over(Window.partitionBy())
    return ids.select("case_id", (rank > F.floor(n * (1 - share))).alias("held")).where("held").select("case_id")


def prerequisites(log: EventLog) -> DataFrame:
    """(activity, requires): activities that precede every occurrence within its case."""
    rows = log.sequenced().select("case_id", "activity", "pos")
    total = rows.groupBy("activity").agg(F.count("*").alias("n"))
    before = rows.select("case_id", F.col("activity").alias("requires"), F.col("pos").alias("p")).groupBy("case_id", "requires").agg(F.min("p").alias("p"))
    seen = rows.join(before, "case_id").where(F.col("p") < F.col("pos")).groupBy("activity", "requires").agg(F.count("*").alias("k"))
    return seen.join(total, "activity").where(F.col("k") == F.col("n")).select("activity", "requires")


def zero_waiting(log: EventLog, share: float = 0.99) -> DataFrame:
    """Activities with their share of steps that begin without waiting, and whether it reaches the threshold."""
    rows = log.edges().groupBy(F.col("target").alias("activity")).agg(F.avg((F.col("seconds") <= 0).cast("double")).alias("s"))
    return rows.select("activity", F.round("s", 6).alias("zero_share"), (F.col("s") >= share).alias("zero_waiting"))


def start_distribution(log: EventLog) -> DataFrame:
    """Share of cases that start with each activity."""
    first = log.events.groupBy("case_id").agg(F.min_by("activity", F.struct("timestamp", "seq")).alias("activity"))
    rows = first.groupBy("activity").agg(F.count("*").alias("n"))
    return rows.select("activity", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def interarrival(log: EventLog) -> DataFrame:
    """(case_id, seconds) since the previous case start of the same day."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    w = Window.partitionBy(F.to_date("start")).orderBy("start", "case_id")
    return t.select("case_id", seconds_between(F.lag("start").over(w), F.col("start")).alias("seconds")).where(F.col("seconds").isNotNull())


def weekday_arrivals(log: EventLog) -> DataFrame:
    """Earliest and latest time of day of case starts by weekday (Sunday = 0), in seconds, and mean starts a day."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    second = F.hour("start") * 3600 + F.minute("start") * 60 + F.floor(F.second("start"))
    days = t.groupBy((F.dayofweek("start") - 1).alias("weekday"), F.to_date("start").alias("day")).agg(F.count("*").alias("n"), F.min(second).alias("lo"), F.max(second).alias("hi"))
    return days.groupBy("weekday").agg(F.min("lo").alias("min_second"), F.max("hi").alias("max_second"), F.round(F.avg("n"), 6).alias("mean_cases"), F.round(F.stddev_pop("n"), 6).alias("std_cases"))


def prefix_next(log: EventLog, longest: int = 5) -> DataFrame:
    """(prefix, next_activity, n, probability): what follows each run of at most `longest` activities, at any place."""
    t = log.traces().select("trace")
    ends = t.select("trace", F.explode(F.sequence(F.lit(1), F.size("trace") - 1)).alias("e")).where(F.size("trace") > 1)
    runs = ends.select("trace", "e", F.explode(F.sequence(F.lit(1), F.least(F.col("e"), F.lit(longest)))).alias("k"))
    runs = runs.select(F.array_join(F.slice("trace", F.col("e") - F.col("k") + 1, F.col("k")), "→").alias("prefix"), F.element_at("trace", F.col("e") + 1).alias("next_activity"))
    rows = runs.groupBy("prefix", "next_activity").agg(F.count("*").alias("n"))
    return rows.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prefix")), 6))


def agent_transitions(log: EventLog, resource: str = "resource") -> DataFrame:
    """(activity, next_activity, source, target, n, probability): hand-overs between agents by pair of activities."""
    w = log.in_case
    rows = log.events.select("activity", F.lead("activity").over(w).alias("next_activity"), F.col(resource).alias("source"), F.lead(resource).over(w).alias("target")).where(F.col("next_activity").isNotNull())
    rows = rows.groupBy("activity", "next_activity", "source", "target").agg(F.count("*").alias("n"))
    return rows.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("activity", "next_activity", "source")), 6))


def agent_activities(log: EventLog, resource: str = "resource") -> DataFrame:
    return log.events.groupBy(F.col(resource).alias("agent")).agg(F.array_join(F.array_sort(F.collect_set("activity")), ",").alias("activities"))


def max_activity_count(log: EventLog) -> DataFrame:
    """How often an activity occurs in a case at most."""
    per = log.events.groupBy("case_id", "activity").agg(F.count("*").alias("n"))
    return per.groupBy("activity").agg(F.max("n").alias("max_per_case"))


def overlap_pairs(log: EventLog, ratio: float = 0.9, end: str = "end_timestamp") -> DataFrame:
    """(a, b, cases, overlapping, concurrent): pairs of activities that run at the same time in their common cases.

    Concurrent if the overlapping cases reach `ratio` of those where both occur.
    """
    rows = log.events.select("case_id", "activity", F.col("timestamp").alias("s"), F.col(end).alias("e"))
    a = rows.select("case_id", *(F.col(c).alias(f"{c}_a") for c in ("activity", "s", "e")))
    b = rows.select("case_id", *(F.col(c).alias(f"{c}_b") for c in ("activity", "s", "e")))
    both = a.join(b, "case_id").where("activity_a < activity_b")
    meet = (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a"))
    per = both.groupBy("case_id", F.col("activity_a").alias("a"), F.col("activity_b").alias("b")).agg(F.max(meet.cast("int")).alias("x"))
    out = per.groupBy("a", "b").agg(F.count("*").alias("cases"), F.sum("x").alias("overlapping"))
    return out.withColumn("concurrent", F.col("overlapping") >= ratio * F.col("cases"))


def enabling_event(log: EventLog, end: str = "end_timestamp") -> DataFrame:
    """(case_id, seq, activity, enabled_by, enabled_at): the latest event of the case that ended by an event's start.

    Ends and starts of a case are put in one order, ends first, and each start looks at the
    end before it; an event without duration, which meets its own end, at the one before that.
    """
    e = log.events.select("case_id", "seq", "activity", "timestamp", F.col(end).alias("end"))
    mark = F.struct("end", "seq", "activity")
    by_end = Window.partitionBy("case_id").orderBy("end", "seq")
    ends = e.where(F.col("end").isNotNull()).select("case_id", F.col("end").alias("at"), F.lit(0).alias("kind"), "seq", "activity", mark.alias("last"), F.lag(mark).over(by_end).alias("before"))
    starts = e.select("case_id", F.col("timestamp").alias("at"), F.lit(1).alias("kind"), "seq", "activity", F.lit(None).cast(ends.schema["last"].dataType).alias("last"), F.lit(None).cast(ends.schema["last"].dataType).alias("before"))
    sweep = Window.partitionBy("case_id").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.when(F.col("kind") == 0, F.struct("last", "before"))
    rows = ends.union(starts).withColumn("ended", F.last(ended, ignorenulls=True).over(sweep)).where(F.col("kind") == 1)
    enabled = F.when(F.col("ended.last.seq") == F.col("seq"), F.col("ended.before")).otherwise(F.col("ended.last"))
    rows = rows.withColumn("enabled", enabled)
    return rows.select("case_id", "seq", "activity", F.col("enabled.activity").alias("enabled_by"), F.col("enabled.end").alias("enabled_at"))


def resource_previous_end(log: EventLog, resource: str = "resource", end: str = "end_timestamp", keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, resource, available_since): the latest end of the same resource's events that started earlier.

    A running maximum by start time within days, carried over from day to day; no join of events.
    """
    rows = log.events.select(*keep, "seq", F.col(resource).alias("resource"), "timestamp", F.col(end).alias("cw_end"))
    rows = intervals.running_max(rows, "resource", F.col("timestamp"), ["timestamp", "seq"], F.col("cw_end"), "available_since")
    return rows.select(*keep, "seq", "resource", "available_since")


def resource_profiles(log: EventLog, resource: str = "resource") -> DataFrame:
    """(resource, activity, n): how often each resource does each activity."""
    return log.events.groupBy(F.col(resource).alias("resource"), "activity").agg(F.count("*").alias("n"))


#: Profiles a block holds; a task compares two blocks.
_BLOCK = 1024


def resource_roles(log: EventLog, resource: str = "resource", least: float = 0.7) -> DataFrame:
    """(resource, role): resources whose activity profiles correlate above `least` share a role, numbered by smallest member.

    Profiles that are multiples of each other correlate fully and are one class, unless
    all their activities are equally frequent, which leaves a correlation undefined: such
    a resource is a role of its own. Classes are compared in blocks, a task keeps of the
    links of its two blocks no more than join their parts, and components are found in
    Spark. Events without a resource are left out.
    """
    p = resource_profiles(log, resource).where("resource IS NOT NULL AND activity IS NOT NULL")
    kinds = p.agg(F.count_distinct("activity").cast("double").alias("k"))
    step = F.struct("activity", F.col("n").cast("double").alias("n"))
    rows = p.groupBy("resource").agg(F.array_sort(F.collect_list(step)).alias("profile"), F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q"))
    rows = rows.crossJoin(F.broadcast(kinds))
    flat = F.col("k") * F.col("q") <= F.col("s") * F.col("s")
    shape = F.transform("profile", lambda x: F.struct(x["activity"].alias("activity"), (x["n"] / F.col("s")).alias("share")))
    rows = rows.withColumn("shape", shape).withColumn("alone", F.when(flat, F.col("resource")))
    whole = Window.partitionBy("shape", "alone")
    rows = graphs.stored(rows.withColumn("id", F.min("resource").over(whole)), "profiles")
    classes = rows.where("id = resource AND alone IS NULL").select("id", F.col("profile.activity").alias("names"), F.col("profile.n").alias("n"), "k", "s", "q")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        codes, names = pd.factorize(np.concatenate(part["names"].to_numpy()))
        held = np.zeros((len(part), len(names)))
        held[np.repeat(np.arange(len(part)), part["names"].map(len)), codes] = np.concatenate(part["n"].to_numpy())
        k, s, q = part["k"].iloc[0], part["s"].to_numpy(), part["q"].to_numpy()
        spread = k * q - s**2
        linked = k * (held @ held.T) - s[:, None] * s > least * np.sqrt(spread[:, None] * spread)
        if not part["own"].iloc[0]:
            left = part["left"].to_numpy(bool)
            linked &= left[:, None] != left
        found, fresh = [], np.ones(len(part), dtype=bool)
        for root in range(len(part)):
            todo = [root] if fresh[root] else []
            fresh[root] = False
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & fresh)
                fresh[new] = False
                found += [(root, x) for x in new]
                todo += list(new)
        ids = part["id"].to_numpy()
        return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["a", "b"])

    text = dict(classes.dtypes)["id"]
    edges = graphs.in_block_pairs(classes, "id", _BLOCK).groupBy("lo", "hi").applyInPandas(links, f"a {text}, b {text}")
    found = graphs.components(rows.select("id"), edges)
    number = found.select("component").distinct().select("component", (F.row_number().over(Window.orderBy("component")) - 1).alias("role"))
    return rows.select("resource", "id").join(found, "id").join(number, "component").select("resource", "role")


def weekly_calendar(log: EventLog, resource: str = "resource", support: float = 0.1) -> DataFrame:
    """(resource, weekday, hour, n, confidence): hours of the week in which a resource works, from a share of its busiest hour."""
    rows = log.events.groupBy(F.col(resource).alias("resource"), (F.dayofweek("timestamp") - 1).alias("weekday"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.max("n").over(Window.partitionBy("resource"))
    return rows.withColumn("confidence", F.round(share, 6)).where(F.col("confidence") >= support)


def calendar_granules(log: EventLog, resource: str = "resource", minutes: int = 60, confidence: float = 0.1, support: float = 0.7, participation: float = 0.4) -> DataFrame:
    """(resource, weekday, granule, n, confidence, participation, accepted): parts of the week a resource works in; Sunday is 0.

    A granule is a stretch of `minutes` of the day. Its confidence is that of the
    activity it suits best: of the days of this weekday on which the resource does the
    activity, the share with one in the granule. A resource's participation is its
    events over those of the busiest resource of each of its activities. Granules of
    enough confidence are accepted; if any is and they hold less than `support` of the
    resource's events, so are the others with the most events, until they do (equal
    numbers in order of the week). Resources of too little participation have none.
    """
    at = F.hour("timestamp") * 60 + F.minute("timestamp")
    rows = log.events.where(F.col(resource).isNotNull()).select(
        F.col(resource).alias("resource"), "activity", F.to_date("timestamp").alias("day"), (F.dayofweek("timestamp") - 1).alias("weekday"), F.floor(at / minutes).cast("int").alias("granule")
    )
    # One row for each day a resource does an activity in a granule; all else follows from these.
    days = rows.groupBy("resource", "activity", "weekday", "granule", "day").agg(F.count("*").alias("n"))
    cell = days.groupBy("resource", "activity", "weekday", "granule").agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    active = days.groupBy("resource", "activity", "weekday").agg(F.count_distinct("day").alias("of"))
    cell = cell.join(active, ["resource", "activity", "weekday"])
    cell = cell.groupBy("resource", "weekday", "granule").agg(F.sum("n").alias("n"), F.round(F.max(F.col("days") / F.col("of")), 6).alias("confidence"))
    done = days.groupBy("resource", "activity").agg(F.sum("n").alias("n"))
    most = done.groupBy("activity").agg(F.max("n").alias("most"))
    part = done.join(most, "activity").groupBy("resource").agg(F.round(F.sum("n") / F.sum("most"), 6).alias("participation"))
    # At most a week of granules each.
    whole = Window.partitionBy("resource")
    sure = F.col("confidence") >= confidence
    held = cell.withColumn("sure", sure).withColumn("all", F.sum("n").over(whole)).withColumn("held", F.sum(F.when(sure, F.col("n")).otherwise(0)).over(whole))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("resource", "sure").orderBy(F.desc("n"), "weekday", "granule").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("before", before).join(part, "resource")
    more = (F.col("held") > 0) & (F.col("held") + F.col("before") < support * F.col("all"))
    return held.select("resource", "weekday", "granule", "n", "confidence", "participation", ((F.col("participation") >= participation) & (F.col("sure") | more)).alias("accepted"))


def simulate(log: EventLog, n_cases: int, seed: int = 7, longest: int = 3, limit: int = 200) -> DataFrame:
    """Simulated events (run of cases) by the longest known suffix of the prefix; cases are spread over tasks.

    Next activities follow `prefix_next` with an end marker; waits are each edge's mean.
    """
    spark = log.df.sparkSession
    ended = log.traces().select("case_id", F.concat("trace", F.array(F.lit("⊥"))).alias("trace"))
    ends = ended.select("trace", F.explode(F.sequence(F.lit(1), F.size("trace") - 1)).alias("e"))
    runs = ends.select("trace", "e", F.explode(F.sequence(F.lit(1), F.least(F.col("e"), F.lit(longest)))).alias("k"))
    runs = runs.select(F.array_join(F.slice("trace", F.col("e") - F.col("k") + 1, F.col("k")), "→").alias("prefix"), F.element_at("trace", F.col("e") + 1).alias("nxt"))
    table: dict[str, list] = {}
    for r in runs.groupBy("prefix", "nxt").agg(F.count("*").alias("n")).collect():
        table.setdefault(r["prefix"], []).append((r["nxt"], r["n"]))
    starts = sorted((r["activity"], r["n"]) for r in start_distribution(log).collect())
    waits = {(r["source"], r["target"]): r["s"] for r in log.edges().groupBy("source", "target").agg(F.avg("seconds").alias("s")).collect()}
    gap = interarrival(log).agg(F.avg("seconds")).first()[0] or 3600.0
    begin = log.events.agg(F.min("timestamp")).first()[0]
    shared = spark.sparkContext.broadcast((table, starts, waits, gap, begin))

    def run(batches):
        import random
        from datetime import timedelta

        import pandas as pd

        table, starts, waits, gap, begin = shared.value
        pick = lambda rng, options: rng.choices([o[0] for o in options], [o[1] for o in options])[0]
        for batch in batches:
            rows = []
            for case in batch["id"]:
                rng, t, trace = random.Random(seed * 1_000_003 + int(case)), begin + timedelta(seconds=gap * int(case)), []
                activity = pick(rng, starts)
                while activity != "⊥" and len(trace) < limit:
                    trace.append(activity)
                    rows.append((f"sim-{case}", activity, t, len(trace)))
                    suffix = next((s for k in range(min(longest, len(trace)), 0, -1) if (s := "→".join(trace[-k:])) in table), None)
                    activity = "⊥" if suffix is None else pick(rng, sorted(table[suffix]))
                    t += timedelta(seconds=waits.get((trace[-1], activity), 0.0) * rng.expovariate(1.0))
            yield pd.DataFrame(rows, columns=["case_id", "activity", "timestamp", "seq"])

    return spark.range(n_cases).mapInPandas(run, "case_id string, activity string, timestamp timestamp_ntz, seq long")
