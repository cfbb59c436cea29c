"""Complexity metrics of a log: sizes, variation, entropies over the prefix automaton, distances of variants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from caseweave.functions import seconds_between, xlogx
from caseweave.log import EventLog
from caseweave.operators.graphs import in_block_pairs

#: Encoded activities start here: a block of letters that sorts and compares by single characters.
_FIRST_CHAR = 0x4E00
MAX_VARIANTS = 300


def size_metrics(log: EventLog) -> DataFrame:
    """Events, cases, activities, trace lengths, mean distinct activities, distinct traces."""
    t = log.traces().select(F.size("trace").alias("len"), F.size(F.array_distinct("trace")).alias("kinds"), F.array_join("trace", "→").alias("v"))
    row = t.agg(
        F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("magnitude"),
        F.count("*").alias("support"),
        F.avg("kinds").alias("level_of_detail"),
        F.min("len").alias("min_length"),
        F.avg("len").alias("avg_length"),
        F.max("len").alias("max_length"),
        F.count_distinct("v").alias("n_variants"),
    )
    variety = log.events.agg(F.count_distinct("activity").alias("variety"))
    rows = row.crossJoin(F.broadcast(variety))
    pct = F.when(F.col("support") > 0, 100.0 * F.col("n_variants") / F.col("support")).otherwise(0.0)
    return rows.select(
        "magnitude", "support", "variety", F.round("level_of_detail", 6).alias("level_of_detail"), "min_length",
        F.round("avg_length", 6).alias("avg_length"), "max_length", "n_variants", F.round(pct, 6).alias("pct_distinct_traces"),
    )


def time_granularity(log: EventLog) -> DataFrame:
    """Mean over cases of the smallest and of the mean gap between events."""
    per = log.edges().groupBy("case_id").agg(F.min("seconds").alias("low"), F.avg("seconds").alias("mean"))
    return per.agg(F.round(F.coalesce(F.avg("low"), F.lit(0.0)), 6).alias("time_granularity_s"), F.round(F.avg("mean"), 6).alias("avg_time_diff_s"))


def order_variation(log: EventLog) -> DataFrame:
    """Share of steps to another activity, per event, and the entropy (ln) of activity shares."""
    w = log.in_case
    rows = log.events.select("activity", (F.col("activity") != F.lag("activity").over(w)).alias("moved"))
    moved = rows.agg(F.count_if("moved").alias("moves"), F.count("*").alias("events"))
    shares = rows.groupBy("activity").agg(F.count("*").alias("n")).select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    entropy = shares.agg(F.round(F.coalesce(-F.sum(xlogx(F.col("p"))), F.lit(0.0)), 6).alias("activity_variation"))
    share = F.when(F.col("events") > 0, F.col("moves") / F.col("events")).otherwise(0.0)
    return moved.select(F.round(share, 6).alias("order_variation")).crossJoin(F.broadcast(entropy))


def structure(log: EventLog) -> DataFrame:
    """Distinct edges E, activities V, structure 1 - E / V^2, acyclic paths 10^(0.08 (1 + E - V)), deviation from random."""
    counts = log.edges().groupBy("source", "target").agg(F.count("*").alias("c"))
    e = counts.agg(F.count("*").alias("edges"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0)).alias("squares"))
    v = log.events.agg(F.count_distinct("activity").alias("activities"))
    rows = e.crossJoin(F.broadcast(v))
    cells = (F.col("activities") * F.col("activities")).cast("double")
    power = 0.08 * (1 + F.col("edges") - F.col("activities"))
    # Sum over all V^2 cells of (c - n / V^2)^2, zero cells included.
    apart = F.sqrt(F.greatest(F.col("squares") - F.col("n") * F.col("n") / cells, F.lit(0.0)))
    share = F.when((F.col("activities") > 0) & (F.col("n") > 0), 1 - apart / F.col("n"))
    return rows.select(
        "edges", "activities",
        F.round(F.when(cells > 0, 1 - F.col("edges") / cells), 6).alias("structure"),
        F.round(F.when(power <= 300, F.pow(F.lit(10.0), power)), 6).alias("acyclic_paths"),
        F.round(share, 6).alias("deviation_from_random"),
    )


def _stepped(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """Rows (activity, pos) with the state after each: a digest of the activities so far, and that before it.

    The digest is a running exclusive or of two hashes of activity and position, so a
    prefix of any length is two numbers. The empty prefix is (0, 0).
    """
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_x", F.xxhash64("pos", "activity")).withColumn("_y", F.xxhash64(F.lit(1), "pos", "activity"))
    rows = rows.withColumn("state", F.struct(F.bit_xor("_x").over(so_far).alias("x"), F.bit_xor("_y").over(so_far).alias("y")))
    parent = F.struct(F.col("state.x").bitwiseXOR(F.col("_x")).alias("x"), F.col("state.y").bitwiseXOR(F.col("_y")).alias("y"))
    return rows.withColumn("parent", parent).drop("_x", "_y")


def _states_of_events(log: EventLog, by: Sequence[str] = ()) -> DataFrame:
    """(by, case_id, timestamp, pos, activity, state, parent) of each event."""
    rows = log.events.select(*by, "case_id", "timestamp", "seq", "activity", F.row_number().over(log.in_case).cast("bigint").alias("pos"))
    return _stepped(rows, log.in_case)


def _states_of_variants(log: EventLog, by: Sequence[str] = ()) -> tuple[DataFrame, WindowSpec]:
    """The states along each distinct trace, (by, pos, activity, state, parent), and the window of a trace."""
    step = F.struct("timestamp", "seq", "activity")
    traces = log.events.groupBy(*by, "case_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["activity"]).alias("trace"))
    traces = traces.groupBy(*by, "trace").agg(F.lit(1)).select(*by, F.struct(F.xxhash64("trace").alias("x"), F.xxhash64(F.lit(1), "trace").alias("y"), F.size("trace").alias("n")).alias("variant"), "trace")
    rows = traces.select(*by, "variant", F.posexplode("trace").alias("pos", "activity")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    window = Window.partitionBy(*by, "variant").orderBy("pos")
    return _stepped(rows, window), window


def prefix_states(log: EventLog, by: Sequence[str] = ()) -> DataFrame:
    """States of the extended prefix automaton: state, parent, depth, first seen, number of events, head.

    A state that its parent saw first among its children carries on its parent's
    partition; every other one opens a partition, and is its head. The head of a state
    is its nearest ancestor, itself included, that opened one, or the root's chain
    (0, 0). States are digests of their prefixes. With `by`, columns of the log that are
    equal within a case, there is an automaton for each of their values.
    """
    by = list(by)
    events = _states_of_events(log, by).withColumn("at", F.struct("timestamp", "case_id", "pos"))
    states = events.groupBy(*by, "state", "parent", F.col("pos").alias("depth")).agg(F.min("at").alias("seen"), F.count("*").alias("events"))
    first = F.row_number().over(Window.partitionBy(*by, "parent").orderBy("seen")) == 1
    opened = states.withColumn("opens", ~first).where("opens").select(*by, "state", F.col("state").alias("opener"))
    # Along each distinct trace, the last state at or before a position that opens a partition.
    chains, along = _states_of_variants(log, by)
    chains = chains.select(*by, "variant", "pos", "state").join(opened, [*by, "state"], "left")
    head = F.last("opener", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    root = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))
    heads = chains.select(*by, "state", F.coalesce(head, root).alias("head")).distinct()
    return states.join(heads, [*by, "state"]).select(*by, "state", "parent", "depth", "seen", "events", "head")


def _entropy(parts: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, normalised): N ln N - sum w ln w over partitions."""
    row = parts.groupBy(*by).agg(F.sum(weight).alias("n"), F.sum(xlogx(F.col(weight))).alias("x"))
    value = xlogx(F.col("n")) - F.col("x")
    norm = F.when(xlogx(F.col("n")) > 0, value / xlogx(F.col("n"))).otherwise(0.0)
    return row.select(*by, F.round(F.coalesce(value, F.lit(0.0)), 6).alias("value"), F.round(F.coalesce(norm, F.lit(0.0)), 6).alias("normalised"))


def epa_entropy(log: EventLog, by: Sequence[str] = ()) -> DataFrame:
    """Variant entropy (states per partition) and sequence entropy (events per partition), plain and normalised."""
    parts = prefix_states(log, by).groupBy(*by, "head").agg(F.count("*").cast("double").alias("states"), F.sum("events").cast("double").alias("events"))
    v = _entropy(parts, "states", by).withColumn("metric", F.lit("variant"))
    rows = v.unionByName(_entropy(parts, "events", by).withColumn("metric", F.lit("sequence")))
    return rows.select(*by, "metric", "value", "normalised")


def epa_entropy_forgetting(log: EventLog, mode: str = "linear", k: float = 1.0) -> DataFrame:
    """Sequence entropy with older events weighing less; the normaliser is that of the unweighted log."""
    bounds = log.events.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    rows = _states_of_events(log).select("state", "timestamp").crossJoin(F.broadcast(bounds))
    age = seconds_between(F.col("timestamp"), F.col("hi"))
    span = seconds_between(F.col("lo"), F.col("hi"))
    share = F.when(span > 0, age / span).otherwise(0.0)
    weight = 1 - share if mode == "linear" else F.exp(-k * share)
    rows = rows.groupBy("state").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).join(prefix_states(log).select("state", "head"), "state")
    parts = rows.groupBy("head").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    row = parts.agg(F.sum("w").alias("total"), F.sum(xlogx(F.col("w"))).alias("x"), F.sum("n").cast("double").alias("n"))
    value = xlogx(F.col("total")) - F.col("x")
    norm = F.when(xlogx(F.col("n")) > 0, value / xlogx(F.col("n"))).otherwise(0.0)
    return row.select(F.round(value, 6).alias("value"), F.round(norm, 6).alias("normalised"))


def enriched(log: EventLog, attributes: list[str]) -> EventLog:
    """The log whose activity is the activity with these attributes, for entropies over richer states."""
    return EventLog(log.events.withColumn("activity", F.concat_ws("|", "activity", *(F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes))))


def n_ties(log: EventLog) -> DataFrame:
    """Sum of the depths of the prefix tree's leaves."""
    p = _states_of_variants(log)[0].groupBy("state", "parent", "pos").agg(F.lit(1))
    leaves = p.join(p.select(F.col("parent").alias("state")).distinct(), "state", "left_anti")
    return leaves.agg(F.coalesce(F.sum("pos"), F.lit(0)).cast("bigint").alias("n_ties"))


def encoded_variants(log: EventLog, top: int = MAX_VARIANTS) -> DataFrame:
    """(id, code, n_cases) of the most frequent variants; one character per activity, in order of name."""
    names = log.events.select("activity").distinct().select("activity", (F.row_number().over(Window.orderBy("activity")) - 1).alias("k"))
    letters = names.agg(F.map_from_entries(F.collect_list(F.struct("activity", F.col("k") + _FIRST_CHAR))).alias("letters"))
    v = log.variants().select("trace", "n_cases", F.array_join("trace", "→").alias("variant")).crossJoin(F.broadcast(letters))
    # Two UTF-8 continuation bytes carry 12 bits, the lead byte four.
    point = lambda a: F.element_at(F.col("letters"), a)
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    code = F.transform("trace", lambda a: F.concat(byte(F.lit(0xE0) + F.shiftright(point(a), 12)), byte(F.lit(0x80) + F.shiftright(point(a), 6).bitwiseAND(63)), byte(F.lit(0x80) + point(a).bitwiseAND(63))))
    code = F.decode(F.unhex(F.array_join(code, "")), "UTF-8")
    rows = v.select(code.alias("code"), "n_cases", "variant").orderBy(F.desc("n_cases"), "variant").limit(top)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("n_cases"), "variant")).alias("id"), "code", "n_cases")


def variant_distances(log: EventLog, top: int = MAX_VARIANTS) -> DataFrame:
    """(i, j, distance, n_i, n_j) for i < j of at most `top` variants, a bound of the metric's definition."""
    v = encoded_variants(log, top)
    a = v.select(F.col("id").alias("i"), F.col("code").alias("a"), F.col("n_cases").alias("n_i"))
    b = v.select(F.col("id").alias("j"), F.col("code").alias("b"), F.col("n_cases").alias("n_j"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", F.levenshtein("a", "b").alias("distance"), "n_i", "n_j")


def edit_distance(log: EventLog, top: int = MAX_VARIANTS) -> DataFrame:
    """Mean edit distance over all pairs of cases of the variants compared, and how many were."""
    v = encoded_variants(log, top).agg(F.sum("n_cases").alias("n"), F.count("*").alias("variants_used"))
    d = variant_distances(log, top).agg(F.coalesce(F.sum(F.col("distance") * F.col("n_i") * F.col("n_j")), F.lit(0)).alias("total"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return v.crossJoin(F.broadcast(d)).select(F.round(F.when(pairs > 0, F.col("total") / pairs).otherwise(0.0), 6).alias("avg_edit_distance"), "variants_used")


#: Edge sets a block holds; a task compares two blocks.
_BLOCK = 1024


def affinity(log: EventLog) -> DataFrame:
    """Mean Jaccard similarity of the directly-follows sets of two cases; two cases without edges count 0.

    Variants with one set of edges are one class with its number of cases. Classes are
    dealt to blocks, and a task adds up the similarities of two blocks by a product of
    their matrices of edges, so no pair is ever a row.
    """
    pairs = F.zip_with(F.slice("trace", F.lit(1), F.greatest(F.size("trace") - 1, F.lit(0))), F.slice("trace", F.lit(2), F.size("trace")), lambda a, b: F.concat_ws("→", a, b))
    sets = log.variants().select(F.array_sort(F.array_distinct(pairs)).alias("edges"), "n_cases").groupBy("edges").agg(F.sum("n_cases").alias("n"))
    base = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.coalesce(F.sum(F.when(F.size("edges") > 0, F.col("n") * (F.col("n") - 1)).otherwise(0)), F.lit(0)).alias("same"))
    held = in_block_pairs(sets.where(F.size("edges") > 0), "edges", _BLOCK)

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(np.concatenate(part["edges"].to_numpy()))
        size = part["edges"].map(len).to_numpy()
        held = np.zeros((len(part), len(names)), dtype=np.float32)
        held[np.repeat(np.arange(len(part)), size), codes] = 1
        n, left, own = part["n"].to_numpy(float), part["left"].to_numpy(bool), bool(part["own"].iloc[0])
        a, b = (slice(None), slice(None)) if own else (left, ~left)
        both = (held[a] @ held[b].T).astype(float)
        alike = both / (size[a][:, None] + size[b][None, :] - both)
        if own:
            np.fill_diagonal(alike, 0.0)
        return pd.DataFrame({"x": [float(n[a] @ alike @ n[b]) * (1.0 if own else 2.0)]})

    cross = held.groupBy("lo", "hi").applyInPandas(summed, "x double").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    n = F.col("cases")
    return base.crossJoin(F.broadcast(cross)).select(F.round(F.when(n > 1, (F.col("same") + F.col("x")) / (n * (n - 1))), 6).alias("affinity"))


def lempel_ziv(log: EventLog) -> DataFrame:
    """Phrases of the Lempel-Ziv parse of the activities in time order; an unfinished tail counts.

    The parse is sequential by definition; the stream is one row, so this suits logs
    whose activities fit one task.
    """
    step = F.struct("timestamp", "case_id", "seq", "activity")
    stream = log.events.agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["activity"]).alias("stream"))

    @F.udf("long")
    def phrases(stream):
        seen, phrase, n = set(), (), 0
        for a in stream:
            phrase += (a,)
            if phrase not in seen:
                seen.add(phrase)
                phrase, n = (), n + 1
        return n + bool(phrase)

    return stream.select(phrases("stream").alias("lempel_ziv"))


def structural_variety(log: EventLog, top: int = MAX_VARIANTS) -> DataFrame:
    """Sum of merge heights of the average-linkage tree of at most `top` variants."""
    spark = log.df.sparkSession
    rows = variant_distances(log, top).collect()
    n = max((r["j"] for r in rows), default=1)
    d = np.full((n, n), np.inf)
    for r in rows:
        d[r["i"] - 1, r["j"] - 1] = d[r["j"] - 1, r["i"] - 1] = r["distance"]
    size, total = np.ones(n), 0.0
    for _ in range(n - 1):
        # The first of equal heights merges first.
        i, j = sorted(divmod(int(np.argmin(d)), n))
        total += d[i, j]
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
    return spark.createDataFrame([(round(float(total), 6), n)], "structural_variety double, variants_used int")
