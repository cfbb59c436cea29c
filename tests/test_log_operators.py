from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from caseweave.log import ObjectLog, WrongModel, event_log
from caseweave.operators import access, complexity, discovery, drift, evolution, miners, performance
from caseweave.operators import filters as flt
from caseweave.operators.filters import Filter, UnknownField
from tests.helpers import of_variants, orders_and_items, rows, three_cases


def test_counts_and_kpis(spark):
    k = access.kpi_summary(three_cases(spark)).first()
    assert (k["cases"], k["events"], k["avg_cycle_time_s"], k["median_cycle_time_s"], k["p90_cycle_time_s"]) == (3, 9, 10500.0, 10800.0, 12240.0)


def test_variants_and_detail(spark):
    log = three_cases(spark)
    assert rows(access.variants(log), "variant", "n_cases", "rank") == {("register order→check stock→ship", 2, 1), ("register order→check stock→cancel", 1, 2)}
    d = access.variant_detail(log, "register order→check stock→ship").first()
    assert d["p90_duration_s"] == 12600.0 and d["n_cases"] == 2


def test_page_and_filters(spark):
    log = three_cases(spark)
    first = access.events_page(log, limit=1).first()
    assert (first["case_id"], first["activity"], first["has_missing"]) == ("case-1", "register order", False)
    names = log.events.columns
    assert log.events.where(flt.where([Filter("case_id", "contains", "CASE-1")], names)).count() == 3
    assert log.events.where(flt.where([Filter("activity", "in", [])], names)).count() == 0
    with pytest.raises(UnknownField):
        flt.where([Filter("nope", "equals", 1)], names)
    assert log.events.where(flt.where([Filter("nope", "equals", 1)], names, strict=False)).count() == 9
    seen = log.filtered(F.col("activity") == "ship")
    assert seen.events.count() == 2 and seen.raw.count() == 9


def test_dfg(spark):
    log = three_cases(spark)
    assert rows(discovery.dfg(log), "source", "target", "frequency", "mean_s") == {("register order", "check stock", 3, 4200.0), ("check stock", "ship", 2, 8550.0), ("check stock", "cancel", 1, 1800.0)}
    assert rows(discovery.dfg_nodes(log), "activity", "frequency") == {("register order", 3), ("check stock", 3), ("ship", 2), ("cancel", 1)}
    assert discovery.prefix_tree(log).count() == 4


def test_complexity(spark):
    log = three_cases(spark)
    s = complexity.structure(log).first()
    assert (s["edges"], s["activities"], s["structure"]) == (3, 4, 0.8125)
    assert complexity.affinity(log).first()["affinity"] == pytest.approx(5 / 9, abs=1e-6)
    assert complexity.edit_distance(log).first()["avg_edit_distance"] == pytest.approx(2 / 3, abs=1e-6)
    parts = complexity.prefix_states(log).groupBy("head").agg(F.count("*").alias("states"), F.sum("events").alias("events"))
    assert sorted(rows(parts, "states", "events")) == [(1, 2), (3, 7)]


def test_generated_variants(spark):
    m = complexity.size_metrics(of_variants(spark, {"a,b,c": 5, "a,c": 3})).first()
    assert (m["magnitude"], m["support"], m["variety"], m["min_length"], m["max_length"], m["n_variants"], m["pct_distinct_traces"]) == (21, 8, 3, 2, 3, 2, 25.0)
    assert complexity.time_granularity(of_variants(spark, {"a,b,c": 5})).first()["avg_time_diff_s"] == 3600.0
    assert complexity.order_variation(of_variants(spark, {"a,b": 10})).first()["activity_variation"] == pytest.approx(math.log(2), abs=1e-6)
    same = complexity.order_variation(of_variants(spark, {"a,a,a": 4})).first()
    assert (same["order_variation"], same["activity_variation"]) == (0.0, 0.0)
    assert complexity.order_variation(of_variants(spark, {"a,a,b,c": 1})).first()["order_variation"] == 0.5
    assert complexity.lempel_ziv(of_variants(spark, {"a,b,a,b,a": 1})).first()[0] == 4


def test_evolution_invariants(spark):
    log = of_variants(spark, {"a,b,c": 20, "a,c": 11})
    r = evolution.evolution(log, "week").orderBy("period").collect()
    assert sum(x["arrivals"] for x in r) == sum(x["completions"] for x in r) == 31
    assert sum(x["events"] for x in r) == 82 and all(x["wip"] >= 0 for x in r) and r[-1]["wip"] == 0
    assert evolution.activity_mix(log, "month", 2).agg(F.sum("n")).first()[0] == 82
    assert evolution.slices_absolute(log, 12).select("case_id").distinct().count() == 31
    assert evolution.slices_sliding(log, 10, 5).count() > 31
    one = evolution.slices_absolute(of_variants(spark, {"a,b": 1}), 12)
    assert rows(one, "slice") == {(0,)}


def test_histograms(spark):
    log = three_cases(spark)
    assert performance.cycle_histogram(log).agg(F.sum("n")).first()[0] == 3
    h = performance.log_histogram(performance.durations(log))
    assert h.count() == 24 and h.agg(F.sum("n")).first()[0] == 3


def test_drift(spark):
    log = of_variants(spark, {"a,b": 10, "a,c": 10})
    v = {(r["i"], r["j"]): r["value"] for r in drift.drift_similarity(log, 4).collect()}
    assert v[0, 0] == 255 and v[0, 1] == 255 and v[0, 3] == 0


def test_miners_accept_what_they_saw(spark):
    for spec in ({"a,b,c": 3, "a,c,b": 2}, {"a,b,d": 1, "a,c,d": 1}, {"a,b,a,b,a": 2, "a": 1}, {"a,b,c,d": 2, "a,c,b,d": 2, "a,e,d": 1}):
        traces = {tuple(k.split(",")): n for k, n in spec.items()}
        tree = miners.mine_tree(spark.createDataFrame([(list(t), n) for t, n in traces.items()], "trace array<string>, n_cases long"))
        assert all(miners.accepts(tree, t) for t in traces), (spec, tree)
    arcs = rows(miners.alpha(of_variants(spark, {"a,b,c": 1, "a,c,b": 1})))
    assert ("place", "source", "a") in arcs and ("transition", "a", "p(a|b)") in arcs and ("transition", "a", "p(a|c)") in arcs


def test_distances():
    assert miners.language_distance({("a", "b"): 2}, {("a", "b"): 5}) == 0
    assert miners.language_distance({("a",): 1}, {("b",): 1}) == pytest.approx(1.0)
    assert miners.transport([[0, 1], [1, 0]], [0.25, 0.75], [0.75, 0.25]) == pytest.approx(0.5)


def test_models_do_not_mix(spark):
    with pytest.raises(WrongModel):
        event_log(orders_and_items(spark))
    assert isinstance(orders_and_items(spark), ObjectLog)


def test_empty_log(spark):
    log = of_variants(spark, {"a": 1}).filtered(F.lit(False))
    assert access.kpi_summary(log).first()["cases"] == 0
    assert complexity.size_metrics(log).first()["magnitude"] == 0
    assert discovery.dfg(log).count() == 0
