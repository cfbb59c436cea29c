"""The interactive views of an event log: pages, column statistics, cases, variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import bin_of, blake2b_64, nullif_nan, seconds_between
from caseweave.log import REQUIRED, EventLog
from caseweave.operators import filters as flt
from caseweave.operators.quantiles import quantiles, with_quantiles


def events_page(log: EventLog, where: Column | None = None, sort: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Events with whether a required column is missing; ties end with seq."""
    rows = log.events if where is None else log.events.where(where)
    rows = rows.withColumn("has_missing", flt.missing(REQUIRED))
    return flt.page(rows, [*flt.parse_sort(sort, rows.columns), F.col("seq")], offset, limit)


def page_total(log: EventLog, where: Column | None = None) -> DataFrame:
    """(total): how many events a page's filter leaves."""
    return (log.events if where is None else log.events.where(where)).agg(F.count("*").alias("total"))


def labelled(df: DataFrame, labels: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """df with the columns of `order` first, the others after them as they came, and columns renamed to their labels."""
    first = [c for c in order or [] if c in df.columns]
    return df.select(*(F.col(f"`{c}`").alias(labels.get(c, c)) for c in [*first, *(c for c in df.columns if c not in first)]))


def indexed(log: EventLog) -> DataFrame:
    """Events with row_index, their place (from 0) in the log sorted by case and time.

    Offsets of cases are summed over the per-case counts, so events are only sorted within their case.
    """
    per = log.events.groupBy("case_id").agg(F.count("*").alias("cw_n"))
    before = F.sum("cw_n").over(Window.orderBy("case_id").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("case_id", F.coalesce(before, F.lit(0)).alias("cw_before"))
    rows = log.events.withColumn("cw_pos", F.row_number().over(log.in_case) - 1)
    return rows.join(per, "case_id").withColumn("row_index", F.col("cw_before") + F.col("cw_pos")).drop("cw_before", "cw_pos")


def column_values(log: EventLog, field: str, q: str | None = None, limit: int = 50) -> DataFrame:
    """The most frequent values of a column as text, with the number of distinct values; ignores the committed filter."""
    if field not in log.raw.columns:
        raise flt.UnknownField(field)
    value = F.col(field).cast("string")
    rows = log.raw.where(F.col(field).isNotNull())
    if q:
        rows = rows.where(flt.like(F.col(field), q))
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    distinct = log.raw.agg(F.count_distinct(field).alias("distinct_values"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(limit).crossJoin(F.broadcast(distinct))


def time_bounds(log: EventLog) -> DataFrame:
    return log.raw.agg(F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"))


def data_quality(log: EventLog, columns: list[str] | None = None) -> DataFrame:
    """One row per column: nulls, share of nulls in percent, distinct values."""
    columns = columns or log.events.columns
    total = F.count("*").alias("total")
    each = [x for k, c in enumerate(columns) for x in (F.count_if(F.col(c).isNull()).alias(f"n{k}"), F.count_distinct(c).alias(f"d{k}"))]
    row = log.events.agg(total, *each)
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("nulls"), F.col(f"d{k}").alias("distinct_values")) for k, c in enumerate(columns)))
    rows = row.select("total", F.explode(parts).alias("x")).select("total", "x.*")
    pct = F.when(F.col("total") > 0, F.col("nulls") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("column", "nulls", F.round(pct, 6).alias("null_pct"), "distinct_values")


def activity_frequency(log: EventLog) -> DataFrame:
    return log.events.groupBy("activity").agg(F.count("*").alias("n"))


def column_specs(log: EventLog, sample: int = 2000, enum_limit: int = 25) -> DataFrame:
    """Display type, role and, for low-cardinality text of the first rows, the values of each column."""
    kinds = {"string": "string", "boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime"}
    head = log.raw.limit(sample)
    text = [c for c, t in head.dtypes if t == "string"]
    sets = head.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in text)).first() if text else {}
    rows = []
    for c, t in log.raw.dtypes:
        values = list(sets[c]) if c in text and sets[c] is not None and 0 < len(sets[c]) <= enum_limit else None
        kind = "enum" if c == "lifecycle" and values else "duration" if t.startswith("interval") else kinds.get(t, "number")
        rows.append((c, kind, c if c in REQUIRED else None, c in REQUIRED, values))
    return log.raw.sparkSession.createDataFrame(rows, "name string, type string, role string, required boolean, enum_values array<string>")


def cases(log: EventLog) -> DataFrame:
    """The case table; the variant is the joined trace."""
    t = log.traces()
    return t.select(
        "case_id",
        "case_start",
        "case_end",
        F.col("duration_s").alias("case_duration_seconds"),
        F.col("n_events").alias("event_count"),
        F.array_join("trace", "→").alias("variant"),
        F.element_at("trace", 1).alias("first_activity"),
        F.element_at("trace", -1).alias("last_activity"),
    )


def variants(log: EventLog, total_cases: int | None = None) -> DataFrame:
    """Variants with counts, share of all cases, mean and median duration, first and last start, and rank."""
    per = cases(log)
    rows = per.groupBy("variant").agg(
        F.count("*").alias("n_cases"),
        F.avg("case_duration_seconds").alias("avg_duration_s"),
        F.min("case_start").alias("first_seen"),
        F.max("case_end").alias("last_seen"),
    )
    rows = with_quantiles(rows, per, "case_duration_seconds", (0.5,), ("variant",)).withColumn("median_duration_s", F.col("q")[0]).drop("q")
    total = F.sum("n_cases").over(Window.partitionBy()) if total_cases is None else F.lit(total_cases)
    rank = F.row_number().over(Window.orderBy(F.desc("n_cases"), F.asc("variant")))
    return rows.withColumn("share", F.col("n_cases") / total).withColumn("rank", rank)


def variant_ids(log: EventLog) -> DataFrame:
    """(variant, variant_id, n_cases): ids are stable digests of the joined trace."""
    rows = log.variants().select(F.array_join("trace", "→").alias("variant"), "n_cases")
    return rows.select("variant", blake2b_64(F.col("variant")).alias("variant_id"), "n_cases")


def variant_detail(log: EventLog, variant: str) -> DataFrame:
    """Duration statistics of one variant; p90 is nearest-rank."""
    rows = cases(log).where(F.col("variant") == variant)
    stats = rows.groupBy("variant").agg(
        F.count("*").alias("n_cases"),
        F.avg("case_duration_seconds").alias("avg_duration_s"),
        F.min("case_duration_seconds").alias("min_duration_s"),
        F.max("case_duration_seconds").alias("max_duration_s"),
    )
    half = quantiles(rows, "case_duration_seconds", (0.5,)).select(F.col("q")[0].alias("median_duration_s"))
    p90 = quantiles(rows, "case_duration_seconds", (0.9,), nearest=True).select(F.col("q")[0].alias("p90_duration_s"))
    return stats.crossJoin(F.broadcast(half)).crossJoin(F.broadcast(p90))


def histogram(values: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Equal-width histogram with empty bins; a single bin if all values are equal."""
    bounds = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where(F.col("lo").isNotNull())
    n = F.when(F.col("hi") > F.col("lo"), F.lit(bins)).otherwise(F.lit(1))
    frame = bounds.select("lo", "hi", n.alias("n_bins"), F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"))
    found = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds))
    found = found.groupBy(bin_of(F.col(column), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins")
    rows = frame.join(F.broadcast(found), "bin", "left")
    return rows.select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def variant_histogram(log: EventLog, variant: str, bins: int = 12) -> DataFrame:
    return histogram(cases(log).where(F.col("variant") == variant), "case_duration_seconds", bins)


def variant_attributes(log: EventLog, variant: str, columns: list[str], top: int = 5) -> DataFrame:
    """The most frequent values of each column among the events of a variant's cases."""
    ids = cases(log).where(F.col("variant") == variant).select("case_id")
    rows = log.events.join(ids, "case_id", "left_semi").select(*(F.col(c).cast("string").alias(c) for c in columns))
    long = rows.unpivot([], columns, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("rank", place).where(F.col("rank") <= top)


def variant_cases(log: EventLog, variant: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """The cases of a variant, latest start first."""
    rows = cases(EventLog(log.raw)).where(F.col("variant") == variant)
    return rows.orderBy(F.desc_nulls_last("case_start"), F.asc("case_id")).offset(offset).limit(limit)


def shaped(df: DataFrame) -> DataFrame:
    """Rows as an interface shows them: NaN is null, times are ISO text."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((nullif_nan(x) if t in ("double", "float") else F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if t.startswith("timestamp") else x).alias(c))
    return df.select(*out)


def kpi_summary(log: EventLog) -> DataFrame:
    """How many cases and events, and how long cases take; quantiles are interpolated."""
    per = log.events.groupBy("case_id").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("n_events"))
    per = per.withColumn("d", seconds_between(F.col("first_ts"), F.col("last_ts")))
    row = per.agg(
        F.count("*").alias("cases"),
        F.coalesce(F.sum("n_events"), F.lit(0)).cast("bigint").alias("events"),
        F.avg("d").alias("avg_cycle_time_s"),
        F.min("d").alias("min_cycle_time_s"),
        F.max("d").alias("max_cycle_time_s"),
        F.min("first_ts").alias("earliest"),
        F.max("last_ts").alias("latest"),
    )
    row = row.join(F.broadcast(quantiles(per, "d", (0.5, 0.9, 0.95))), F.lit(True), "left")
    span = seconds_between(F.col("earliest"), F.col("latest"))
    r = lambda x, name: F.round(x, 6).alias(name)
    return row.select(
        "cases",
        "events",
        r(F.col("avg_cycle_time_s"), "avg_cycle_time_s"),
        r(F.col("q")[0], "median_cycle_time_s"),
        r(F.col("q")[1], "p90_cycle_time_s"),
        r(F.col("q")[2], "p95_cycle_time_s"),
        "min_cycle_time_s",
        "max_cycle_time_s",
        "earliest",
        "latest",
        r(F.when(span > 0, F.col("cases") * 86400.0 / span).otherwise(F.col("cases").cast("double")), "throughput_per_day"),
    )
