"""Column functions shared by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end as a double; both sides may be timestamps without time zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin number from 0; the last bin is closed; one bin if low = high."""
    width = (high - low) / F.lit(float(bins))
    return F.when(high <= low, F.lit(0)).otherwise(F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")


def half_even_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number by rounding bins * (value - low) / (high - low) half to even, as cycle histograms are defined."""
    share = F.lit(float(bins)) * (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.least(F.coalesce(F.bround(share).cast("int"), F.lit(0)), F.lit(bins - 1))


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """The element at floor(n * q) of a sorted array, from 0, without interpolation."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(F.floor(n * F.lit(q)).cast("int") + 1, n))


def xlogx(x: Column) -> Column:
    """x ln x, 0 for x = 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def nullif_nan(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def blake2b_64(text: Column) -> Column:
    """Hex of the 64-bit BLAKE2b digest of a string, for variant ids."""
    import hashlib

    def digests(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())

    return pandas_udf(digests, "string")(text)


def time_ranked(df: DataFrame, time: str, *ties: str, grain: str = "hour") -> DataFrame:
    """df with rank, the place of each row (from 1) in order of time and ties, and total, the number of rows.

    Rows are only sorted within their hour (or another grain); the counts of the
    hours before are added from a small table, so no task sorts the whole log.
    """
    rows = df.withColumn("cw_hour", F.date_trunc(grain, F.col(time)))
    per = rows.groupBy("cw_hour").agg(F.count("*").alias("cw_n"))
    before = F.sum("cw_n").over(Window.orderBy("cw_hour").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("cw_hour", F.coalesce(before, F.lit(0)).alias("cw_before"), F.sum("cw_n").over(Window.partitionBy()).alias("total"))
    at = F.row_number().over(Window.partitionBy("cw_hour").orderBy(time, *ties))
    rows = rows.withColumn("cw_at", at).join(per, "cw_hour")
    return rows.withColumn("rank", F.col("cw_before") + F.col("cw_at")).drop("cw_hour", "cw_at", "cw_before")
