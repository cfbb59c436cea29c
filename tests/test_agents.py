"""What agent simulations read, the sweep for enabling events, quantiles by key; against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from caseweave.log import EventLog
from caseweave.operators import agents, simulation
from caseweave.operators.quantiles import quantiles, with_quantiles
from caseweave.plans import agent_queries
from tests.helpers import three_cases
from tests.test_catalog import test_query_matches_sql as matches_sql

TIMED = "case_id string, activity string, timestamp timestamp_ntz, end_timestamp timestamp_ntz, seq long"


@pytest.mark.parametrize("name", ["agent_prefix_next", "interaction_net", "weekday_runs", "padded_log", "usage_filtered"])
def test_agent_query(spark, name):
    matches_sql(spark, name)


def test_enabling_event_by_sweep(spark):
    rng, zero = random.Random(3), datetime(2026, 1, 1)
    rows = []
    for case in "pqr":
        for seq in range(40):  # seq restarts in each case; many ties, events without duration and without an end
            start = zero + timedelta(hours=rng.randrange(12))
            end = None if rng.random() < 0.1 else start + timedelta(hours=rng.randrange(3))
            rows.append((case, rng.choice("abc"), start, end, seq))
    log = EventLog(spark.createDataFrame(rows, TIMED))
    want = {}
    for case, _, start, _, seq in rows:
        earlier = [(e, s, a) for c, a, _, e, s in rows if c == case and s != seq and e is not None and e <= start]
        want[case, seq] = max(earlier)[::2] if earlier else (None, None)
    got = {(r["case_id"], r["seq"]): (r["enabled_at"], r["enabled_by"]) for r in simulation.enabling_event(log).collect()}
    assert got == want


def test_quantiles_by_key(spark):
    rng = random.Random(5)
    groups = {"x": [rng.random() for _ in range(900)], "y": [1.0] * 50 + [2.0], None: [3.0, 5.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("z", None)], "k string, v double")
    got = {r["k"]: r["q"] for r in quantiles(df, "v", (0.5, 0.9), ("k",)).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, [0.5, 0.9])))
    every = with_quantiles(df.select("k").distinct(), df, "v", (0.5,), ("k",))
    assert {r["k"]: r["q"] and r["q"][0] for r in every.collect()}.keys() == {"x", "y", "z", None}


def test_padding_codes_and_ends(spark):
    log = three_cases(spark)
    rows = agents.padded(log).collect()
    assert len(rows) == 12 and sum(r["activity"] == agents.END for r in rows) == 3
    assert {r["resource"]: r["code"] for r in agents.resource_codes(log).collect()} == {"alice": 0, "bob": 1, "carol": 2}
    assert agents.with_ends(log).events.where("end_timestamp <> timestamp").isEmpty()
    empty = EventLog(log.df.where("false"))
    assert agents.padded(empty).isEmpty() and agents.weekday_runs(empty).isEmpty() and agents.representative(empty, "ship").isEmpty()
    assert [r["pos"] for r in agents.representative(log, "cancel").orderBy("pos").collect()] == [1, 2, 3]
