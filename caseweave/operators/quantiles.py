"""Exact quantiles without gathering a group: values are counted, dealt into bins, and looked up in one bin each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins between two powers of two.
BINS = 65_536


def value_bin(v: Column) -> Column:
    """A whole number that grows with a double: equal steps between powers of two, alike on both sides of 0.

    It needs no look at the data, and holds even where log2 is off by a rounding: the last step below a power
    of two and the first above it meet. Values beyond 2**1000 share a bin, as do those below 2**-1000.
    """
    size = F.greatest(F.least(F.abs(v), F.lit(2.0**1000)), F.lit(2.0**-1000))
    power = F.floor(F.log2(size))
    step = ((power + 1001) * BINS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * BINS)).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v > 0, step).otherwise(-step))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, joined on keys; null keys meet."""
    right = right.withColumnsRenamed({k: f"cw_key_{k}" for k in keys})
    met = reduce(and_, (F.col(k).eqNullSafe(F.col(f"cw_key_{k}")) for k in keys))
    return left.join(right, met, how).drop(*(f"cw_key_{k}" for k in keys))


def with_quantiles(rows: DataFrame, df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """rows, one by key, with the column q of `quantiles`; null where a key has no value."""
    return _joined(rows, quantiles(df, value, probs, keys), keys, "left")


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """(keys, q array<double>): linearly interpolated quantiles of value by key; nulls are left out.
    Without keys an empty table gives one row of nulls.

    With nearest, the value at place int(p n), from 0, of the n values in order instead.

    Equal values are counted with partial aggregation, and fall into bins by their size alone. A running
    sum over a group's bins finds those that hold the ranks sought, and only in these bins values are put in order. So
    no task sorts more than the bins of a group, or the distinct values of one bin.
    """
    found = described(df, value, probs, keys, nearest)
    return found.select(*keys, "q")


def described(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """(keys, n, mean, lo, hi, q): number, mean, smallest and largest value and quantiles by key, all from one count of equal values."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("cw_v"))
    binned = counts.groupBy(*keys, "cw_v").agg(F.count("*").alias("cw_n")).withColumn("cw_bin", value_bin(F.col("cw_v")))
    sums = {"cw_total": F.sum("cw_m"), "cw_sum": F.sum("cw_sum"), "cw_lo": F.min("cw_lo"), "cw_hi": F.max("cw_hi")}
    bins = binned.groupBy(*keys, "cw_bin").agg(F.sum("cw_n").alias("cw_m"), F.sum(F.col("cw_v") * F.col("cw_n")).alias("cw_sum"), F.min("cw_v").alias("cw_lo"), F.max("cw_v").alias("cw_hi"))
    bins = bins.select(*keys, "cw_bin", "cw_m", *(x.over(Window.partitionBy(*keys)).alias(c) for c, x in sums.items()))
    before = F.coalesce(F.sum("cw_m").over(Window.partitionBy(*keys).orderBy("cw_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("cw_total") - 1
    at = [F.least(F.floor(F.lit(float(p)) * F.col("cw_total")), last).cast("double") if nearest else F.lit(float(p)) * last for p in probs]
    ranks = F.array(*(F.struct(F.lit(2 * k + side).alias("i"), f(x).cast("long").alias("rank")) for k, x in enumerate(at) for side, f in enumerate((F.floor, F.ceil))))
    sought = bins.withColumn("cw_before", before).withColumn("cw_ranks", F.filter(ranks, lambda r: (r["rank"] >= F.col("cw_before")) & (r["rank"] < F.col("cw_before") + F.col("cw_m"))))
    sought = sought.where(F.size("cw_ranks") > 0).drop("cw_m")
    inside = _joined(binned, sought, [*keys, "cw_bin"])
    upto = F.col("cw_before") + F.sum("cw_n").over(Window.partitionBy(*keys, "cw_bin").orderBy("cw_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("cw_upto", upto)
    hit = F.filter("cw_ranks", lambda r: (r["rank"] < F.col("cw_upto")) & (r["rank"] >= F.col("cw_upto") - F.col("cw_n")))
    hits = inside.select(*keys, "cw_v", *sums, F.explode(hit).alias("r"))
    found = hits.groupBy(*keys).agg(*(F.first(c).alias(c) for c in sums), *(F.max(F.when(F.col("r.i") == i, F.col("cw_v"))).alias(f"cw_{i}") for i in range(2 * len(probs))))
    parts = [F.col(f"cw_{2 * k}") + (x - F.floor(x)) * (F.col(f"cw_{2 * k + 1}") - F.col(f"cw_{2 * k}")) for k, x in enumerate(at)]
    return found.select(*keys, F.col("cw_total").alias("n"), (F.col("cw_sum") / F.col("cw_total")).alias("mean"), F.col("cw_lo").alias("lo"), F.col("cw_hi").alias("hi"), F.array(*parts).alias("q"))
