"""Series, change points, norms, Student's t, permutation and bootstrap against direct computations."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import drift, series, statistics

START = datetime(2024, 1, 1)


def test_pelt_finds_planted_changes_and_the_optimum():
    rng = np.random.default_rng(1)
    signal = np.concatenate([rng.normal(m, 0.3, (n, 3)) for m, n in ((0, 20), (3, 14), (1, 26))])
    assert series.changes(signal, step=1) == [20, 34, 60]
    for seed in range(4):
        noise = np.random.default_rng(seed).normal(0, 1, (24, 2)) + np.repeat([[0.0], [1.5]], 12, axis=0)
        cost = series.KernelCost(noise)
        for penalty in (0.5, 1.0, 3.0):
            got = series.pelt(cost, 24, penalty, 2, 1)
            assert got == series.pelt(cost, 24, penalty, 2, 1, prune=False)
            price = lambda ends: sum(cost(a, b) + penalty for a, b in zip([0, *ends[:-1]], ends, strict=True))  # noqa: B023, E731
            assert all(price(got) <= price([*cut, 24]) + 1e-9 for k in range(4) for cut in combinations(range(2, 23), k) if all(b - a >= 2 for a, b in zip([0, *cut], [*cut, 24], strict=True)))


def plain_ward(points, cutoff):
    groups = [[k] for k in range(len(points))]
    far = lambda a, b: math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(points[a].mean(axis=0) - points[b].mean(axis=0))
    while len(groups) > 1:
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > cutoff:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("cutoff", [0.0, 1.0, 3.0, 8.0, 1e9])
def test_ward_equals_merging_the_nearest(cutoff):
    rng = np.random.default_rng(2)
    points = rng.normal(0, 1, (40, 3)) + rng.integers(0, 3, 40)[:, None] * 2.0
    found = series.ward(points, cutoff)
    assert {frozenset(np.flatnonzero(found == c).tolist()) for c in set(found.tolist())} == plain_ward(points, cutoff)


def test_change_points_by_cluster(spark):
    rng = random.Random(3)
    rows = []
    for name, at in (("up1", 12), ("up2", 12), ("late1", 30), ("late2", 30)):
        rows += [(name, k, (10.0 if k < at else 80.0) + rng.random()) for k in range(40)]
    rows += [("flat", k, 50.0 + rng.random()) for k in range(40)]
    df = spark.createDataFrame(rows, "constraint string, pos int, value double").repartition(3)
    grouped = series.clusters(df)
    got = {r["constraint"]: r["cluster"] for r in grouped.collect()}
    assert set(got) == {"up1", "up2", "late1", "late2"} and got["up1"] == got["up2"] != got["late1"] == got["late2"]
    ends: dict = {}
    for r in series.change_points(df, grouped).collect():
        ends.setdefault(r["cluster"], []).append(r["change"])
    # The penalty falls below the number of segments, so noise may add a place; the planted ones are there.
    assert {12, 40} <= set(ends[got["up1"]]) and {30, 40} <= set(ends[got["late1"]]) and max(map(len, ends.values())) <= 4
    assert series.clusters(df.limit(0)).count() == 0


def test_matrix_distances():
    rng = np.random.default_rng(4)
    for _ in range(5):
        a, b = rng.integers(0, 6, (7, 7)).astype(float), rng.integers(0, 6, (7, 7)).astype(float)
        for name, order in (("fro", "fro"), ("nuc", "nuc"), ("inf", np.inf), ("l2", 2)):
            assert drift.matrix_distance(a, b, name) == pytest.approx(np.linalg.norm(a - b, order), abs=1e-6)
        assert drift.matrix_distance(a, b, "cos") == pytest.approx(1 - a.ravel() @ b.ravel() / np.linalg.norm(a) / np.linalg.norm(b))
        heights = [[np.histogram(r, bins=np.arange(-0.5, 7), density=True)[0] for r in m] for m in (a, b)]
        assert drift.matrix_distance(a, b, "earth") == pytest.approx(sum(np.abs(np.sort(x) - np.sort(y)).mean() for x, y in zip(*heights, strict=True)))
    none = np.zeros((2, 2))
    assert drift.matrix_distance(none, np.full((2, 2), 9.0), "earth") == drift.matrix_distance(none, np.full((2, 2), 9.0), "cos") == 18.0


def test_t_agrees_with_tables(spark):
    """Two-sided critical values of Student's t, and the normal limit."""
    table = [(12.7062, 1, 0.05), (4.302653, 2, 0.05), (2.228139, 10, 0.05), (3.169273, 10, 0.01), (2.262157, 9, 0.05), (1.959964, 10_000_000, 0.05), (0.0, 5, 1.0), (-2.228139, 10, 0.05), (636.6192, 1, 0.001)]
    got = spark.createDataFrame([(t, n) for t, n, _ in table], "t double, n int").select(statistics.t_p_value(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([p for _, _, p in table], abs=2e-7)


def test_paired_tests_and_ranks(spark):
    rng = random.Random(5)
    base = [rng.gauss(10, 2) for _ in range(10)]
    groups = {"a": base, "b": [x + rng.gauss(0.05, 0.4) for x in base], "c": [x + 3 + rng.gauss(0, 0.2) for x in base], "d": [x + 3 for x in base], "e": [x + 9 for x in base]}
    runs = spark.createDataFrame([("m", e, str(k), v) for e, vs in groups.items() for k, v in enumerate(vs)], "metric string, experiment string, run string, value double")
    got = {(r["a"], r["b"]): r for r in statistics.paired_tests(runs).collect()}
    gap = np.array(groups["a"]) - np.array(groups["b"])
    pair = got.get(("a", "b")) or got["b", "a"]
    assert abs(pair["t"]) == pytest.approx(abs(gap.mean() / (gap.std(ddof=1) / math.sqrt(10))))
    assert got["a", "e"]["p_value"] < 1e-6
    assert {r["experiment"]: r["rank"] for r in statistics.ranks(runs).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2, "e": 3}


def log_of(spark, seed, n, swapped=0.1):
    rng, rows = random.Random(seed), []
    for c in range(n):
        trace = ["a", *(["b", "c"] if rng.random() > swapped else ["c", "b"]), *["d"] * rng.randrange(3)]
        rows += [(f"{seed}-{c}", x, START + timedelta(hours=c, minutes=7 * k + rng.randrange(5)), k) for k, x in enumerate(trace)]
    return EventLog(spark.createDataFrame(rows, "case_id string, activity string, timestamp timestamp_ntz, seq long"))


@pytest.mark.parametrize("test", [statistics.permutation_test, statistics.bootstrap_test])
def test_resampling_tells_logs_apart_and_only_those(spark, test):
    p = lambda a, b, **how: test(a, b, resamples=200, **how).first()["p_value"]
    one = log_of(spark, 1, 150)
    assert test(one, one, resamples=50).first()["p_value"] == 1.0
    assert p(one, log_of(spark, 2, 150, 0.6), timed=False) < 0.01
    # Between logs of one process small values are as rare as they should be.
    like = [p(log_of(spark, 10 + k, 120), log_of(spark, 30 + k, 120), timed=False) for k in range(8)]
    assert 0.15 < np.mean(like) < 0.85 and sum(x < 0.05 for x in like) <= 2
    assert p(one, log_of(spark, 2, 150, 0.6), timed=False) == p(one, EventLog(log_of(spark, 2, 150, 0.6).df.repartition(5)), timed=False)


def test_resampling_of_empty_logs(spark):
    none = EventLog(log_of(spark, 1, 3).df.limit(0))
    assert tuple(statistics.permutation_test(none, none, resamples=5).first())[0] is None
