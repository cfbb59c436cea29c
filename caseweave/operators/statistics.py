"""Tests on logs and on measurements: Student's t as a column, paired ranks, permutation and bootstrap over all cases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.log import EventLog

#: Coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def ln_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 0.5."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + k)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forward by Lentz's method."""
    tiny = 1e-300
    off_zero = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    d = 1 / off_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def turn(state: Column, coefficient: Column) -> Column:
        d = 1 / off_zero(1 + coefficient * state["d"])
        c = off_zero(1 + coefficient / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def walk(state: Column, m: Column) -> Column:
        # A term of the even and one of the odd coefficients.
        k, half = F.ceil(m / 2).cast("double"), m % 2 == 1
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        return turn(state, F.when(half, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * terms)), start, walk, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 60) -> Column:
    """The regularised incomplete beta function I_x(a, b), for a, b >= 0.5."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    near = front * _fraction(a, b, x, terms) / a
    far = 1 - front * _fraction(b, a, 1 - x, terms) / b
    value = F.when(x < (a + 1) / (a + b + 2), near).otherwise(far)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(value)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with df degrees of freedom; null where either is."""
    df = df.cast("double")
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def paired_tests(runs: DataFrame) -> DataFrame:
    """(metric, a, b, n, mean_a, mean_b, t, p_value) of runs (metric, experiment, run, value), for experiments a and b with mean_a < mean_b (then by name).

    Differences without spread have no t: their p-value is 0, or 1 where all are 0.
    """
    mean = runs.groupBy("metric", "experiment").agg(F.avg("value").alias("mean"))
    rows = runs.join(mean, ["metric", "experiment"])
    side = lambda x: rows.select("metric", "run", F.col("experiment").alias(x), F.col("value").alias(f"v_{x}"), F.col("mean").alias(f"mean_{x}"))
    both = side("a").join(side("b"), ["metric", "run"]).where(F.struct("mean_a", "a") < F.struct("mean_b", "b"))
    gap = F.col("v_a") - F.col("v_b")
    found = both.groupBy("metric", "a", "b", "mean_a", "mean_b").agg(F.count("*").alias("n"), F.avg(gap).alias("gap"), F.stddev_samp(gap).alias("spread"))
    t = F.when(F.col("spread") > 0, F.col("gap") / (F.col("spread") / F.sqrt("n")))
    p = F.when(F.col("n") < 2, None).when(t.isNotNull(), t_p_value(t, F.col("n") - 1)).otherwise((F.col("gap") == 0).cast("double"))
    return found.select("metric", "a", "b", "n", "mean_a", "mean_b", t.alias("t"), p.alias("p_value"))


def ranks(runs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, experiment, mean, rank): experiments by mean; one shares the smallest rank of those before it that it does not differ from, else takes the next.

    A metric's experiments, not its runs, come together in one task.
    """
    tests = paired_tests(runs).where(F.coalesce(F.col("p_value") >= alpha, F.lit(False)))
    like = tests.groupBy("metric", F.col("b").alias("experiment")).agg(F.collect_set("a").alias("like"))
    mean = runs.groupBy("metric", "experiment").agg(F.avg("value").alias("mean")).join(like, ["metric", "experiment"], "left")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part, got = part.sort_values(["mean", "experiment"]), {}
        for name, like in zip(part["experiment"], part["like"], strict=True):
            shared = [got[x] for x in (like if like is not None else ()) if x in got]
            got[name] = min(shared) if shared else max(got.values(), default=0) + 1
        return part.assign(rank=part["experiment"].map(got).astype("int32"))[["metric", "experiment", "mean", "rank"]]

    return mean.groupBy("metric").applyInPandas(number, "metric string, experiment string, mean double, rank int")


def step_features(log: EventLog, timed: bool = False) -> DataFrame:
    """(case_id, features array<string>): each case's directly-follows steps, start and end included; timed steps tell the power of two of their seconds."""
    steps = log.sequenced().select("case_id", "activity", "next_activity", "pos", "n", "timestamp", "next_timestamp")
    seconds = F.greatest(F.timestamp_diff("SECOND", F.col("timestamp"), F.col("next_timestamp")), F.lit(0))
    power = F.coalesce(F.floor(F.log2(1.0 + seconds)).cast("string"), F.lit("")) if timed else F.lit(None).cast("string")
    step = F.concat_ws("→", "activity", F.coalesce(F.col("next_activity"), F.lit("⊥")), power)
    begins = F.when(F.col("pos") == 1, F.concat_ws("→", F.lit("⊤"), "activity"))
    rows = steps.select("case_id", F.explode(F.array_compact(F.array(begins, step))).alias("f"))
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_list("f")).alias("features"))


def _variants(a: EventLog, b: EventLog, timed: bool) -> DataFrame:
    """(features, n_a, n_b): how often each multiset of steps occurs in two logs."""
    both = step_features(a, timed).select("features", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    both = both.unionByName(step_features(b, timed).select("features", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return both.groupBy("features").agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"))


def control_flow_distance(a: EventLog, b: EventLog, timed: bool = False) -> DataFrame:
    """(distance): total variation between the steps of two logs."""
    steps = _variants(a, b, timed).select("n_a", "n_b", F.explode("features").alias("f")).groupBy("f").agg(F.sum("n_a").cast("double").alias("a"), F.sum("n_b").cast("double").alias("b"))
    whole = Window.partitionBy()
    gap = F.abs(F.col("a") / F.nullif(F.sum("a").over(whole), F.lit(0.0)) - F.col("b") / F.nullif(F.sum("b").over(whole), F.lit(0.0)))
    return steps.select(gap.alias("gap")).agg(F.round(F.coalesce(F.sum("gap") / 2, F.lit(0.0)), 9).alias("distance"))


def _resampled(variants: DataFrame, draw, replicates: int, seed: int) -> DataFrame:
    """(f, replicate, a, b): steps of two samples by replicate; replicate 0 is the logs themselves.

    draw(rng, n_a, n_b) gives `replicates` pairs of counts of one multiset. Each multiset draws from its own
    seed, so results do not depend on partitions; a task adds up its draws by step before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for seed, features, n_a, n_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.empty((replicates + 1, 2))
                counts[0] = n_a, n_b
                counts[1:] = draw(np.random.default_rng(seed & (2**63 - 1)), n_a, n_b)
                for f in features:
                    if f in sums:
                        sums[f] += counts
                    else:
                        sums[f] = counts.copy()
            if len(sums) * replicates > 4_000_000:
                yield _sums(sums)
                sums = {}
        yield _sums(sums)

    rows = variants.select(F.xxhash64("features", F.lit(seed)), "features", "n_a", "n_b")
    return rows.mapInArrow(run, "f string, replicate int, a double, b double").groupBy("f", "replicate").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = sorted(sums)
    n = len(sums[names[0]]) if names else 0
    flat = np.concatenate([sums[f] for f in names]) if names else np.zeros((0, 2))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(names, object), n), pa.string()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(names)), pa.int32()), pa.array(flat[:, 0]), pa.array(flat[:, 1])],
        names=["f", "replicate", "a", "b"],
    )


def _p_value(drawn: DataFrame) -> DataFrame:
    """(statistic, p_value) from the distances of all replicates to that of the logs themselves."""
    sizes = drawn.groupBy("replicate").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col(f"all_{c}"), F.lit(0.0)), F.lit(0.0))
    far = drawn.join(sizes, "replicate").groupBy("replicate").agg((F.sum(F.abs(share("a") - share("b"))) / 2).alias("distance"))
    own = F.max(F.when(F.col("replicate") == 0, F.col("distance"))).over(Window.partitionBy())
    hits = F.sum((F.col("distance") >= F.col("own") - 1e-12).cast("int"))
    return far.withColumn("own", own).agg(F.round(F.max("own"), 6).alias("statistic"), F.round(hits / F.count("*"), 6).alias("p_value"))


def permutation_test(a: EventLog, b: EventLog, resamples: int = 1000, timed: bool = True, seed: int = 42) -> DataFrame:
    """(statistic, p_value): distance of two logs' steps against that of random labellings of all their cases.

    Each case goes to the first log with that log's share of the cases, so a multiset of steps that occurs n
    times draws a binomial count; no variant is left out.
    """
    variants = _variants(a, b, timed)
    whole = variants.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b")).first()
    share = (whole["a"] or 0) / max((whole["a"] or 0) + (whole["b"] or 0), 1)

    def draw(rng: np.random.Generator, n_a: int, n_b: int) -> np.ndarray:
        left = rng.binomial(n_a + n_b, share, resamples)
        return np.stack((left, n_a + n_b - left), axis=1)

    return _p_value(_resampled(variants, draw, resamples, seed))


def bootstrap_test(a: EventLog, b: EventLog, resamples: int = 1000, timed: bool = False, seed: int = 42) -> DataFrame:
    """(statistic, p_value): distance of two logs' steps against that of two samples of their sizes, both drawn from the first log with replacement.

    Counts of a multiset of steps are Poisson draws, so sizes vary as the counts do; no variant is left out.
    """
    variants = _variants(a, b, timed)
    whole = variants.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b")).first()
    rate = (whole["b"] or 0) / max(whole["a"] or 0, 1)

    def draw(rng: np.random.Generator, n_a: int, n_b: int) -> np.ndarray:
        return np.stack((rng.poisson(n_a, resamples), rng.poisson(n_a * rate, resamples)), axis=1)

    return _p_value(_resampled(variants, draw, resamples, seed))
