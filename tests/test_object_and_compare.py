from __future__ import annotations

import os
import random
import re
from dataclasses import replace
from datetime import datetime

import pytest

from caseweave.log import ObjectLog
from caseweave.operators import compare, ocel, simulation
from caseweave.plans.tables import object_log
from tests.helpers import of_variants, orders_and_items, rows, three_cases

DIR = "/root/testdata/sf0.001"


def test_object_log(spark):
    log = orders_and_items(spark)
    assert rows(ocel.interaction_graph(log)) == {("item", "order", 2), ("item", "item", 1)}
    assert rows(ocel.lifecycle(log), "type", "median_lifetime_s") == {("order", 3 * 86400.0), ("item", 2.5 * 86400.0)}
    longest = ocel.longest_lived(log)
    assert longest.first()["lifetime_s"] == 3 * 86400.0
    assert ("o1", 4) in rows(longest, "oid", "n_events")
    assert rows(ocel.activity_types(log)) >= {("add item", "order", 2, 1), ("add item", "item", 2, 2), ("ship", "item", 1, 2)}
    assert ocel.interaction_degree(log).count() == 0
    assert log.flatten("item").traces().count() == 2
    assert ("ship", "item", True) in rows(ocel.variable_arcs(log))


def test_two_logs(spark):
    a, b = of_variants(spark, {"a,b,c": 3, "a,c,b": 1}), of_variants(spark, {"a,b,c": 2, "a,b,d": 2})
    status = {(r["source"], r["target"]): r["status"] for r in compare.dfg_diff(a, b).collect()}
    assert (status["b", "d"], status["c", "b"], status["a", "b"]) == ("only_b", "only_a", "shared")
    assert rows(compare.variant_diff({"a": a, "b": b}), "variant", "n_a", "n_b") == {("a→c→b", 1, 0), ("a→b→d", 0, 2), ("a→b→c", 3, 2)}
    assert all(r["jaccard"] == 1.0 for r in compare.similarity_jaccard({"x": a, "y": a}).collect())
    assert all(r["mean"] == 0.0 for r in compare.fidelity(a, [a]).collect())
    assert compare.ngram_tv(a, b).first()[0] > 0


def test_simulation_inputs(spark):
    log = three_cases(spark)
    assert rows(simulation.prerequisites(log)) == {("check stock", "register order"), ("ship", "register order"), ("ship", "check stock"), ("cancel", "register order"), ("cancel", "check stock")}
    assert rows(simulation.start_distribution(log), "activity", "share") == {("register order", 1.0)}
    assert rows(simulation.interarrival(log)) == {("case-2", 1800.0)}
    sim = simulation.simulate(log, 30)
    assert sim.select("case_id").distinct().count() == 30
    assert rows(sim.select("activity").distinct()) <= {("register order",), ("check stock",), ("ship",), ("cancel",)}


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("kind", ["descendants", "inheritance", "cobirth", "codeath"])
def test_object_graphs_exchange_lines_by_event_once(spark, kind):
    """Relations are neither exchanged spelled out nor by several keys, and births come from rows before repeats are dropped."""
    log = object_log(spark, DIR)
    df = ocel.object_graph(log, kind)
    keys = [re.sub(r"#\d+L?", "", line.split("Exchange hashpartitioning(", 1)[1]) for line in exchanges(df)]
    assert keys and not [k for k in keys if k.startswith(("eid, oid", "eid, type")) and kind == "descendants"]
    assert rows(df) == rows(ocel.object_graph(replace(log, repeated=None), kind))


def shared(seed, events, objects, most):
    rng = random.Random(seed)
    return sorted({(f"e{e}", f"o{o}", f"t{o % 3}") for e in range(events) for o in rng.choices(range(objects), k=rng.randrange(1, most))} | {("e0", "o1", "t2")})


@pytest.mark.parametrize("most, classes", [(4, False), (40, True)])
def test_interaction_with_few_and_many_pairs(spark, monkeypatch, most, classes):
    """Few pairs are formed by event without classes of objects; many go by classes; both as a look at all pairs."""
    data = shared(16, 60, 90, most)
    relations = spark.createDataFrame([(*x, "a", datetime(2024, 1, 1), None) for x in data] * 2, "eid string, oid string, type string, activity string, timestamp timestamp_ntz, qualifier string")
    log = ObjectLog(None, None, relations, None)
    want: dict = {}
    for x, y in {((p[2], p[1]), (q[2], q[1])) for p in data for q in data if p[0] == q[0] and (p[2], p[1]) < (q[2], q[1])}:
        want[x[0], y[0]] = want.get((x[0], y[0]), 0) + 1
    df = ocel.interaction_graph(log)
    assert rows(df, "source", "target", "pairs") == {(*k, n) for k, n in want.items()}
    assert ("bit_xor" in df._jdf.queryExecution().optimizedPlan().toString()) == classes
    assert rows(ocel._interaction_of_classes(relations.select("eid", "oid", "type").distinct())) == rows(df)
    assert ocel.interaction_graph(ObjectLog(None, None, relations.limit(0), None)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_interaction_exchanges_lines_by_event_and_pairs(spark):
    keys = [re.sub(r"#\d+L?", "", line.split("Exchange hashpartitioning(", 1)[1]) for line in exchanges(ocel.interaction_graph(object_log(spark, DIR)))]
    assert keys and all(k.startswith(("concat_ws(", "oid_a, oid_b, type_a, type_b", "type_a, type_b, ")) for k in keys)
