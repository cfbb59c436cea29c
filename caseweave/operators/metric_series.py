"""Complexity metrics over time: the metrics of a log, for each slice of its cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import xlogx
from caseweave.log import EventLog
from caseweave.operators import complexity


def sliced(log: EventLog, slices: DataFrame) -> EventLog:
    """The log of all slices, with column slice; slices is (case_id, slice) and may give a case to several.

    A case is a case of its own in each of its slices.
    """
    rows = log.events.select("case_id", "activity", "timestamp", "seq").join(slices.select("case_id", "slice"), "case_id")
    return EventLog(rows.withColumn("case_id", F.concat_ws("\u0001", F.col("slice").cast("string"), "case_id")))


def slice_metrics(log: EventLog, slices: DataFrame) -> DataFrame:
    """Size metrics of whole cases by slice; slices is (case_id, slice) and may repeat cases."""
    rows = log.traces().join(slices, "case_id")
    return rows.groupBy("slice").agg(
        F.sum("n_events").cast("bigint").alias("magnitude"),
        F.count("*").alias("support"),
        F.round(F.avg("n_events"), 6).alias("avg_length"),
        F.count_distinct(F.array_join("trace", "→")).alias("n_variants"),
        F.round(F.avg("duration_s"), 6).alias("avg_duration_s"),
    )


def metric_series(log: EventLog, slices: DataFrame) -> DataFrame:
    """One row a slice: sizes, variation, structure, gaps in time and entropies of its cases.

    slices is (case_id, slice), as the slicing functions of `evolution` give it; slices
    without cases have no row. Every aggregate has the slice in its keys, so all slices
    are one job each for cases, activities, edges and prefix states.
    """
    part = sliced(log, slices)
    step = F.struct("timestamp", "seq", "activity")
    cases = part.events.groupBy("slice", "case_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["activity"]).alias("trace"))
    variants = cases.groupBy("slice", "trace").agg(F.count("*").alias("n")).select("slice", "n", F.size("trace").alias("len"), F.size(F.array_distinct("trace")).alias("kinds"))
    n, total = F.col("n"), lambda c: F.sum(F.col(c) * F.col("n"))
    sizes = variants.groupBy("slice").agg(
        total("len").cast("bigint").alias("magnitude"),
        F.sum(n).alias("support"),
        F.round(total("kinds") / F.sum(n), 6).alias("level_of_detail"),
        F.min("len").alias("min_length"),
        F.round(total("len") / F.sum(n), 6).alias("avg_length"),
        F.max("len").alias("max_length"),
        F.count("*").alias("n_variants"),
        F.round(100.0 * F.count("*") / F.sum(n), 6).alias("pct_distinct_traces"),
    )
    counts = part.events.groupBy("slice", "activity").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", n / F.sum("n").over(Window.partitionBy("slice")))
    kinds = shares.groupBy("slice").agg(F.count("*").alias("variety"), F.round(-F.sum(xlogx(F.col("p"))), 6).alias("activity_variation"))
    # A step's slice is the first part of its case; edges carry it in the case_id alone.
    w = part.in_case
    steps = part.events.select(
        "slice", "case_id", F.col("activity").alias("source"), F.lead("activity").over(w).alias("target"), F.lead("seq").over(w).isNotNull().alias("has_next"),
        (F.unix_micros(F.lead("timestamp").over(w).cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("us"),
    ).where("has_next")
    edges = steps.groupBy("slice", "source", "target").agg(F.count("*").alias("c"))
    edges = edges.groupBy("slice").agg(F.count("*").alias("edges"), F.sum("c").alias("steps"), F.sum(F.when(F.col("source") != F.col("target"), F.col("c")).otherwise(0)).alias("moves"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    gaps = steps.groupBy("slice", "case_id").agg((F.min("us") / 1e6).alias("low"), (F.avg("us") / 1e6).alias("mean"))
    gaps = gaps.groupBy("slice").agg(F.round(F.avg("low"), 6).alias("low"), F.round(F.avg("mean"), 6).alias("avg_time_diff_s"))
    heads = complexity.epa_entropy(part, ["slice"]).groupBy("slice").agg(
        *(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_entropy{suffix}") for m in ("variant", "sequence") for c, suffix in (("value", ""), ("normalised", "_normalised")))
    )
    rows = sizes.join(kinds, "slice").join(edges, "slice", "left").join(gaps, "slice", "left").join(heads, "slice")
    v, e, c = F.col("variety"), F.coalesce("edges", F.lit(0)), F.coalesce("steps", F.lit(0))
    cells = (v * v).cast("double")
    power = 0.08 * (1 + e - v)
    apart = F.sqrt(F.greatest(F.col("squares") - c * c / cells, F.lit(0.0)))
    return rows.select(
        *sizes.columns, "variety", "activity_variation",
        F.round(F.coalesce("moves", F.lit(0)) / F.col("magnitude"), 6).alias("order_variation"),
        e.alias("edges"),
        F.round(1 - e / cells, 6).alias("structure"),
        F.round(F.when(power <= 300, F.pow(F.lit(10.0), power)), 6).alias("acyclic_paths"),
        F.round(F.when(c > 0, 1 - apart / c), 6).alias("deviation_from_random"),
        F.coalesce("low", F.lit(0.0)).alias("time_granularity_s"), "avg_time_diff_s",
        "variant_entropy", "variant_entropy_normalised", "sequence_entropy", "sequence_entropy_normalised",
    )
