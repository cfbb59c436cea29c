"""Comparison of two or more logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import discovery
from caseweave.operators.quantiles import quantiles, value_bin


def _tagged(logs: dict[str, EventLog], of) -> DataFrame:
    """The rows of `of` for each log, with its name in log_id."""
    return reduce(DataFrame.unionByName, (of(log).withColumn("log_id", F.lit(name)) for name, log in logs.items()))


def dfg_diff(a: EventLog, b: EventLog) -> DataFrame:
    """Edges of two logs with both frequencies and whether they are shared."""
    both = _tagged({"a": a, "b": b}, discovery.edge_counts)
    n = lambda x: F.coalesce(F.sum(F.when(F.col("log_id") == x, F.col("frequency"))), F.lit(0)).alias(f"freq_{x}")
    rows = both.groupBy("source", "target").agg(n("a"), n("b"))
    status = F.when(F.col("freq_b") == 0, "only_a").when(F.col("freq_a") == 0, "only_b").otherwise("shared")
    return rows.withColumn("status", status).withColumn("delta", F.col("freq_b") - F.col("freq_a"))


def variant_diff(logs: dict[str, EventLog], top: int = 60) -> DataFrame:
    """Variants by log with shares; the largest absolute change against the first log decides the order."""
    names = list(logs)
    rows = _tagged(logs, lambda log: log.variants().select(F.array_join("trace", "→").alias("variant"), "n_cases"))
    wide = rows.groupBy("variant").agg(*(F.coalesce(F.sum(F.when(F.col("log_id") == x, F.col("n_cases"))), F.lit(0)).alias(f"n_{x}") for x in names))
    whole = Window.partitionBy()
    share = lambda x: F.col(f"n_{x}") / F.nullif(F.sum(f"n_{x}").over(whole), F.lit(0))
    wide = wide.select("*", *(F.coalesce(share(x), F.lit(0.0)).alias(f"share_{x}") for x in names))
    apart = [F.abs(F.col(f"share_{x}") - F.col(f"share_{names[0]}")) for x in names[1:]]
    wide = wide.withColumn("max_delta", F.greatest(*apart) if len(apart) > 1 else apart[0])
    rank = F.row_number().over(Window.orderBy(F.desc("max_delta"), F.asc("variant")))
    return wide.withColumn("rank", rank).where(F.col("rank") <= top)


def activity_deltas(a: EventLog, b: EventLog) -> DataFrame:
    """Frequency and mean seconds to the next event of each activity in both logs."""
    freq = _tagged({"a": a, "b": b}, lambda log: log.events.groupBy("activity").agg(F.count("*").alias("n")))
    wait = _tagged({"a": a, "b": b}, lambda log: log.edges().groupBy(F.col("source").alias("activity")).agg(F.avg("seconds").alias("s")))
    pick = lambda x, c: F.max(F.when(F.col("log_id") == x, F.col(c)))
    f = freq.groupBy("activity").agg(F.coalesce(pick("a", "n"), F.lit(0)).alias("freq_a"), F.coalesce(pick("b", "n"), F.lit(0)).alias("freq_b"))
    w = wait.groupBy("activity").agg(F.round(pick("a", "s"), 6).alias("sojourn_a"), F.round(pick("b", "s"), 6).alias("sojourn_b"))
    return f.join(w, "activity", "left").withColumn("freq_delta", F.col("freq_b") - F.col("freq_a"))


def similarity_jaccard(logs: dict[str, EventLog]) -> DataFrame:
    """Jaccard similarity of activities, edges, variants and footprints for each pair of logs; empty sets are equal."""
    kinds = {
        "activities": lambda log: log.events.select(F.col("activity").alias("key")),
        "edges": lambda log: log.edges().select(F.concat_ws("→", "source", "target").alias("key")),
        "variants": lambda log: log.traces().select(F.array_join("trace", "→").alias("key")),
        "footprints": lambda log: discovery.footprints(log).select(F.concat_ws("|", "relation", "source", F.coalesce("target", F.lit(""))).alias("key")),
    }
    rows = reduce(DataFrame.unionByName, (_tagged(logs, of).withColumn("kind", F.lit(k)) for k, of in kinds.items()))
    held = rows.groupBy("kind", "key").agg(F.collect_set("log_id").alias("logs"))
    names = sorted(logs)
    has = lambda x: F.array_contains("logs", x).cast("int")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = held.groupBy("kind").agg(*(x for k, (a, b) in enumerate(pairs) for x in (F.sum(has(a) * has(b)).alias(f"i{k}"), F.sum(F.greatest(has(a), has(b))).alias(f"u{k}"))))
    parts = F.array(*(F.struct(F.lit(a).alias("log_a"), F.lit(b).alias("log_b"), F.when(F.col(f"u{k}") > 0, F.col(f"i{k}") / F.col(f"u{k}")).otherwise(1.0).alias("jaccard")) for k, (a, b) in enumerate(pairs)))
    every = log_kinds(sums, kinds)
    return every.select("kind", F.explode(F.coalesce(parts, F.array(*(F.struct(F.lit(a).alias("log_a"), F.lit(b).alias("log_b"), F.lit(1.0).alias("jaccard")) for a, b in pairs)))).alias("x")).select("kind", "x.log_a", "x.log_b", F.round("x.jaccard", 6).alias("jaccard"))


def log_kinds(sums: DataFrame, kinds: dict) -> DataFrame:
    """sums with a row for every kind, also those without any key."""
    frame = sums.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return frame.join(sums, "kind", "left")


def wasserstein(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """1-Wasserstein distance of a column's distributions in two tables: the area between their CDFs."""
    both = a.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(F.col(column).cast("double"), F.lit(0), F.lit(1)))
    by = both.where(F.col("v").isNotNull()).groupBy("v").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b")).withColumn("bin", value_bin(F.col("v")))
    # Running sums and next values over bins, then within them: one task never holds all distinct values.
    bins = by.groupBy("bin").agg(F.sum("a").alias("bin_a"), F.sum("b").alias("bin_b"), F.min("v").alias("lo"))
    whole, order = Window.partitionBy(), Window.orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    bins = bins.select("bin", *(zero(F.sum(f"bin_{c}").over(upto)).alias(f"before_{c}") for c in "ab"), *(F.sum(f"bin_{c}").over(whole).alias(f"all_{c}") for c in "ab"), F.lead("lo").over(order).alias("after"))
    inside = Window.partitionBy("bin").orderBy("v")
    share = lambda c: (F.col(f"before_{c}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0))) / F.nullif(F.col(f"all_{c}"), F.lit(0))
    width = F.coalesce(F.lead("v").over(inside), F.col("after")) - F.col("v")
    return by.join(bins, "bin").select((F.abs(share("a") - share("b")) * width).alias("area")).agg(F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 6).alias("distance"))


def ngrams(log: EventLog, n: int = 3) -> DataFrame:
    """(gram, share) of activity n-grams, traces padded on both ends."""
    pad = F.array_repeat(F.lit("#"), n - 1)
    t = log.traces().select(F.concat(pad, "trace", pad).alias("t"))
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, F.lit(n)), "→"))
    rows = t.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("k"))
    return rows.select("gram", (F.col("k") / F.sum("k").over(Window.partitionBy())).alias("share"))


def ngram_tv(a: EventLog, b: EventLog, n: int = 3) -> DataFrame:
    """Total variation distance of the n-gram distributions."""
    x, y = ngrams(a, n).withColumnRenamed("share", "p"), ngrams(b, n).withColumnRenamed("share", "q")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return x.join(y, "gram", "full_outer").agg(F.round(F.coalesce(F.sum(gap) / 2, F.lit(0.0)), 6).alias("ngd"))


def handover_matrix(log: EventLog, resource: str = "resource", top: int = 8) -> DataFrame:
    """Probabilities of handing over between the most active resources, by row."""
    keep = log.events.groupBy(F.col(resource).alias("r")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("r")).limit(top).select("r")
    pairs = log.events.select(F.col(resource).alias("source"), F.lead(resource).over(log.in_case).alias("target")).where(F.col("target").isNotNull())
    pairs = pairs.join(F.broadcast(keep.withColumnRenamed("r", "source")), "source").join(F.broadcast(keep.withColumnRenamed("r", "target")), "target")
    rows = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    return rows.select("source", "target", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6).alias("probability"))


def transition_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frobenius distance of two matrices given as (source, target, probability)."""
    x, y = a.select("source", "target", F.col("probability").alias("p")), b.select("source", "target", F.col("probability").alias("q"))
    gap = F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return x.join(y, ["source", "target"], "full_outer").agg(F.round(F.sqrt(F.coalesce(F.sum(gap * gap), F.lit(0.0))), 6).alias("distance"))


def circadian(logs: dict[str, EventLog]) -> DataFrame:
    """Events by hour of the day, count and share, for each log."""
    rows = _tagged(logs, lambda log: log.events.select(F.hour("timestamp").alias("hour"))).groupBy("log_id", "hour").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("log_id")), 6))


def arrivals(logs: dict[str, EventLog], span_limit_days: int = 90) -> DataFrame:
    """Case starts per day, or per week of seven days from the first start where the span is longer than the limit."""
    starts = _tagged(logs, lambda log: log.events.groupBy("case_id").agg(F.min("timestamp").alias("start")))
    bounds = starts.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    rows = starts.crossJoin(F.broadcast(bounds))
    days = F.date_diff(F.col("hi"), F.col("lo"))
    width = F.when(days > span_limit_days, 7).otherwise(1)
    return rows.groupBy("log_id", F.floor(F.date_diff(F.col("start"), F.col("lo")) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cycle_time_bins(logs: dict[str, EventLog], bins: int = 20, cap: float = 0.97) -> DataFrame:
    """Case durations in equal bins up to the pooled quantile, longer ones in an overflow bin."""
    rows = _tagged(logs, lambda log: log.traces().select("duration_s"))
    top = quantiles(rows, "duration_s", (cap,)).select(F.col("q")[0].alias("top"))
    at = F.when(F.col("top") <= 0, 0).otherwise(F.least(F.floor(F.col("duration_s") / (F.col("top") / bins)), F.lit(bins)))
    return rows.crossJoin(F.broadcast(top)).groupBy("log_id", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fidelity(real: EventLog, simulated: list[EventLog], n: int = 3) -> DataFrame:
    """Mean and population deviation over runs of five distances: n-grams, absolute, circadian, relative and cycle time."""
    hours = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / F.lit(3.6e9)

    def frames(log: EventLog) -> dict[str, DataFrame]:
        starts = F.min("timestamp").over(Window.partitionBy("case_id"))
        e = log.events.select(hours(F.col("timestamp")).alias("aedd"), F.hour("timestamp").alias("cedd"), (hours(F.col("timestamp")) - hours(starts)).alias("redd"))
        return {"aedd": e, "cedd": e, "redd": e, "ctdd": log.traces().select((F.col("duration_s") / 3600.0).alias("ctdd"))}

    runs = []
    for sim in simulated:
        runs.append(ngram_tv(real, sim, n).select(F.lit("ngd").alias("metric"), F.col("ngd").alias("value")))
        x, y = frames(real), frames(sim)
        runs += [wasserstein(x[m], y[m], m).select(F.lit(m).alias("metric"), F.col("distance").alias("value")) for m in x]
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy("metric").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_pop("value"), 3).alias("std"))
