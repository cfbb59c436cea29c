from __future__ import annotations

import random
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import miners, quantiles, resources, simulation
from caseweave.sources import writers
from tests.helpers import of_variants, rows, three_cases


def timed(spark, spans) -> EventLog:
    """Events from (case, activity, resource, start hour, end hour) on Monday 2024-01-01."""
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    data = [(c, a, r, t(s), t(e), k) for k, (c, a, r, s, e) in enumerate(spans)]
    return EventLog(spark.createDataFrame(data, "case_id string, activity string, resource string, timestamp timestamp_ntz, end_timestamp timestamp_ntz, seq long"))


def test_intervals(spark):
    log = timed(spark, [("1", "a", "r", 8, 10), ("1", "b", "r", 9, 11), ("1", "c", "r", 11, 12), ("2", "a", "q", 8, 9)])
    assert rows(resources.concurrency(log)) == {("r", 2, 3), ("q", 1, 1)}
    calendar = spark.createDataFrame([(1, 9 * 3600, 12 * 3600)], "weekday int, begin_s int, end_s int")
    assert rows(resources.working_seconds(log.events, calendar), "key", "working_s") == {(0, 3600.0), (1, 7200.0), (2, 3600.0), (3, 0.0)}
    assert rows(resources.in_calendar(log.events, calendar), "seq", "inside") == {(0, False), (1, True), (2, True), (3, False)}
    enabled = {r["seq"]: r["enabled_by"] for r in simulation.enabling_event(log).collect()}
    assert enabled == {0: None, 1: None, 2: "b", 3: None}
    assert rows(resources.delays(log), "seq", "delay_s") == {(2, 0.0)}


def test_seq_that_restarts_in_each_case(spark):
    log = timed(spark, [("1", "a", "r", 8, 9), ("1", "b", "r", 10, 11), ("2", "a", "q", 8, 9), ("2", "b", "q", 12, 13), ("3", "a", "p", 8, 9), ("3", "b", "p", 9, 10)])
    again = EventLog(log.df.withColumn("seq", F.col("seq") % 2))
    assert rows(resources.delays(again), "case_id", "seq", "delay_s") == {("1", 1, 3600.0), ("2", 1, 10800.0), ("3", 1, 0.0)} and resources.delays(again).count() == 3
    calendar = spark.createDataFrame([(1, 9 * 3600, 12 * 3600)], "weekday int, begin_s int, end_s int")
    assert resources.working_seconds(again.events, calendar).count() == 6


def test_bpmn(spark):
    def paths(spec):
        """Names of tasks on every way from the start to the end that passes no element twice."""
        root = ET.fromstring(writers.bpmn(miners.inductive(of_variants(spark, spec))))
        of = lambda tag: [e for e in root.iter() if e.tag.endswith(tag)]
        names, after = {e.get("id"): e.get("name") for e in of("task")}, {}
        for e in of("sequenceFlow"):
            after.setdefault(e.get("sourceRef"), []).append(e.get("targetRef"))
        ids = {e.get("id") for e in root.iter()}
        assert all(b in ids for to in after.values() for b in to)
        out, todo = set(), [("start", ())]
        while todo:
            x, seen = todo.pop()
            if x == "end":
                out.add(tuple(names[y] for y in seen if y in names))
            todo += [(y, (*seen, x)) for y in after.get(x, []) if y not in seen]
        return out

    assert paths({"a,b,c": 1}) == {("a", "b", "c")}
    assert paths({"a,b & <c>,d": 1, "a,e,d": 1}) == {("a", "b & <c>", "d"), ("a", "e", "d")}
    assert paths({"a,b,c,d": 1, "a,c,b,d": 1}) == {("a", "b", "d"), ("a", "c", "d")}
    assert paths({"a": 3}) == {("a",)}


def test_trees_of_all_variants(spark):
    """More variants than ever reached the driver: the rarest ones are mined too."""
    seen = {",".join(["a", *(str(x) for x in range(12) if k >> x & 1), "z"]): 1 for k in range(1500)}
    tree = miners.mine_tree(of_variants(spark, seen).variants())
    assert miners.leaves(tree) == {"a", "z", *(str(x) for x in range(11))}
    assert all(miners.accepts(tree, tuple(v.split(","))) for v in list(seen)[::25])


def test_quantiles_by_bins(spark):
    rng = random.Random(4)
    data = [(rng.choice("xyz"), rng.choice([float(rng.randrange(40)), rng.random() * 1e6])) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r["k"]: r["q"] for r in quantiles.quantiles(df, "v", probs, ["k"]).collect()}
    for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect():
        assert got.get(r["k"]) == (r["q"] and pytest.approx(r["q"]))
    assert quantiles.quantiles(df, "v", (0.5,)).first()["q"] == pytest.approx([df.agg(F.median("v")).first()[0]])
    assert quantiles.quantiles(df.limit(0), "v", (0.5,)).first()["q"] == [None]
    assert quantiles.quantiles(df.limit(0), "v", (0.5,), ["k"]).count() == 0


def test_calendars_fall_back(spark):
    log = three_cases(spark)
    assert rows(resources.calendars(log, least=100), "resource", "origin") == {(r, "always") for r in ("alice", "bob", "carol")}
    assert rows(resources.calendars(log, least=4), "resource", "origin") == {("alice", "own"), ("bob", "own"), ("carol", "log")}


def test_fit(spark):
    flat = spark.range(1000).select(F.lit("u").alias("k"), (F.col("id") / 10.0).alias("v"))
    same = spark.range(10).select(F.lit("f").alias("k"), F.lit(3.0).alias("v"))
    got = {r["k"]: (r["family"], r["distance"]) for r in resources.fit_distributions(flat.union(same), "k", "v").collect()}
    assert got["u"][0] == "uniform" and got["f"] == ("fixed", 0.0)


def test_gate_and_series(spark):
    m = resources.meets(three_cases(spark), ("cost",), 5, 50).first()
    assert (m["missing_columns"], m["enough_events"], m["enough_cases"]) == ("cost", True, False)
    s = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", 90.0), ("c", 99.0), ("c", 97.0)], "constraint string, value double")
    assert rows(resources.redundant_series(s)) == {("a", True), ("b", False), ("c", True)}


def replays(arcs, trace) -> bool:
    """Whether a net can produce a trace from source to sink, by search over markings."""
    take, put = {}, {}
    for kind, a, b in arcs:
        if kind == "place":
            take.setdefault(b, set()).add(a)
        else:
            put.setdefault(a, set()).add(b)
    seen, todo = set(), [(frozenset(["source"]), 0)]
    while todo:
        marking, k = todo.pop()
        if marking == {"sink"} and k == len(trace):
            return True
        if (marking, k) in seen:
            continue
        seen.add((marking, k))
        for t in set(take) | set(put):
            silent = t.startswith("tau")
            if take.get(t, set()) <= marking and (silent or (k < len(trace) and trace[k] == t)):
                todo.append(((marking - take.get(t, set())) | put.get(t, set()), k if silent else k + 1))
    return False


@pytest.mark.parametrize("spec", [{"a,b,c": 3, "a,c,b": 2}, {"a,b,d": 1, "a,c,d": 1}, {"a,b,a,b,a": 2, "a": 1}])
def test_nets_replay_their_log(spark, spec):
    log = of_variants(spark, spec)
    arcs = rows(miners.inductive_net(log))
    assert all(replays(arcs, tuple(v.split(","))) for v in spec)
    if max(len(v) for v in spec) < 7:
        arcs = rows(miners.alpha(log))
        assert all(replays(arcs, tuple(v.split(","))) for v in spec)


def test_alpha_takes_more_than_a_hundred_activities(spark):
    """A sequence with a choice among a hundred: the place before it joins them all."""
    many = [f"x{k:03d}" for k in range(105)]
    log = of_variants(spark, {f"a,{x},z": 1 for x in many})
    arcs = rows(miners.alpha(log))
    left = f"p(a|{','.join(many)})"
    assert {("place", left, x) for x in many} <= arcs and ("transition", "a", left) in arcs
    assert all(replays(arcs, ("a", x, "z")) for x in many[:3])
