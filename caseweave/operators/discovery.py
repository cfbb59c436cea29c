"""Directly-follows graphs and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators.quantiles import described


def dfg(log: EventLog) -> DataFrame:
    """Edges with frequency and mean, median, smallest and largest seconds."""
    rows = described(log.edges(), "seconds", (0.5,), ("source", "target"))
    r = lambda x, name: F.round(x, 6).alias(name)
    return rows.select("source", "target", F.col("n").alias("frequency"), r(F.col("mean"), "mean_s"), r(F.col("q")[0], "median_s"), F.col("lo").alias("min_s"), F.col("hi").alias("max_s"))


def edge_counts(log: EventLog) -> DataFrame:
    return log.edges().groupBy("source", "target").agg(F.count("*").alias("frequency"))


def edge_total(log: EventLog) -> DataFrame:
    """(total, expected): the sum of all edge frequencies, and events less cases, which it must equal."""
    total = edge_counts(log).agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total"))
    return total.crossJoin(F.broadcast(log.events.agg((F.count("*") - F.count_distinct("case_id")).alias("expected"))))


def endpoints(log: EventLog) -> DataFrame:
    """(activity, starts, ends): in how many cases it comes first or last."""
    per = log.events.groupBy("case_id").agg(
        F.min_by("activity", F.struct("timestamp", "seq")).alias("first"), F.max_by("activity", F.struct("timestamp", "seq")).alias("last")
    )
    both = per.select(F.explode(F.array(F.struct(F.col("first").alias("activity"), F.lit(1).alias("s")), F.struct(F.col("last").alias("activity"), F.lit(0).alias("s")))).alias("x"))
    return both.groupBy("x.activity").agg(F.sum("x.s").alias("starts"), F.sum(1 - F.col("x.s")).alias("ends"))


def dfg_nodes(log: EventLog) -> DataFrame:
    """Nodes of the directly-follows graph; frequency is the largest of outgoing edges, starts and ends."""
    out = edge_counts(log).groupBy(F.col("source").alias("activity")).agg(F.sum("frequency").alias("outgoing"))
    rows = log.events.select("activity").distinct().join(out, "activity", "left").join(endpoints(log), "activity", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "activity",
        F.greatest(zero("outgoing"), zero("starts"), zero("ends")).alias("frequency"),
        zero("starts").alias("starts"),
        zero("ends").alias("ends"),
    )


def trace_position(log: EventLog) -> DataFrame:
    """Mean place of an activity in its case, from 0 (first) to 1 (last); 0 in cases of one event."""
    at = F.when(F.col("n") > 1, (F.col("pos") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return log.sequenced().groupBy("activity").agg(F.round(F.avg(at), 6).alias("mean_position"))


def variant_coverage(log: EventLog, coverage: float) -> DataFrame:
    """The most frequent variants: those before which less than `coverage` of the cases has been reached."""
    v = log.variants().select(F.array_join("trace", "→").alias("variant"), "n_cases")
    order = Window.orderBy(F.desc("n_cases"), F.asc("variant"))
    before = F.coalesce(F.sum("n_cases").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_cases").over(Window.partitionBy())
    rows = v.select("variant", "n_cases", (before / total).alias("reached_before"))
    return rows.where(F.col("reached_before") < coverage)


def covered(log: EventLog, coverage: float) -> EventLog:
    """The log restricted to cases of the covered variants."""
    ids = log.traces().select("case_id", F.array_join("trace", "→").alias("variant"))
    ids = ids.join(variant_coverage(log, coverage), "variant", "left_semi").select("case_id")
    return EventLog(log.events.join(ids, "case_id", "left_semi"))


def prefix_tree(log: EventLog) -> DataFrame:
    """Nodes of the tree of all trace prefixes: prefix, parent, label, depth, cases that pass, cases that end there."""
    v = log.variants()
    depth = F.explode(F.sequence(F.lit(1), F.size("trace"))).alias("depth")
    p = v.select("trace", "n_cases", depth)
    p = p.select(F.slice("trace", F.lit(1), F.col("depth")).alias("path"), "depth", "n_cases", (F.col("depth") == F.size("trace")).alias("last"))
    p = p.groupBy("path", "depth").agg(F.sum("n_cases").alias("frequency"), F.sum(F.when(F.col("last"), F.col("n_cases")).otherwise(0)).alias("ends"))
    parent = F.array_join(F.slice("path", F.lit(1), F.col("depth") - 1), "→")
    return p.select(F.array_join("path", "→").alias("prefix"), parent.alias("parent"), F.element_at("path", -1).alias("label"), "depth", "frequency", "ends")


def footprints(log: EventLog) -> DataFrame:
    """Tagged relations: directly_follows where only one direction occurs, parallel where both do, start, end."""
    e = log.edges().select("source", "target").distinct()
    back = e.select(F.col("source").alias("t"), F.col("target").alias("s"))
    both = e.join(back, (e["source"] == back["s"]) & (e["target"] == back["t"]), "left")
    tag = F.when(F.col("s").isNotNull(), "parallel").otherwise("directly_follows")
    rows = both.select(tag.alias("relation"), "source", "target")
    ends = endpoints(log)
    one = lambda name, c: ends.where(F.col(c) > 0).select(F.lit(name).alias("relation"), F.col("activity").alias("source"), F.lit(None).cast("string").alias("target"))
    return rows.unionByName(one("start", "starts")).unionByName(one("end", "ends"))


def transition_matrix(log: EventLog, top: int = 25) -> DataFrame:
    """Probabilities between the most frequent activities, renormalised among them, to 4 places."""
    counts = log.events.groupBy("activity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("activity")).limit(top)
    keep = counts.select("activity")
    e = edge_counts(log)
    e = e.join(F.broadcast(keep.withColumnRenamed("activity", "source")), "source").join(F.broadcast(keep.withColumnRenamed("activity", "target")), "target")
    share = F.col("frequency") / F.sum("frequency").over(Window.partitionBy("source"))
    return e.select("source", "target", F.round(share, 4).alias("probability"))


def heuristics_edges(log: EventLog, dependency: float = 0.5) -> DataFrame:
    """Dependency measures of the heuristics miner, and which edges reach the threshold."""
    e = edge_counts(log)
    back = e.select(F.col("source").alias("t"), F.col("target").alias("s"), F.col("frequency").alias("reverse"))
    e = e.join(back, (e["source"] == back["s"]) & (e["target"] == back["t"]), "left").select("source", "target", "frequency", F.coalesce("reverse", F.lit(0)).alias("reverse"))
    ab, ba = F.col("frequency"), F.col("reverse")
    value = F.when(F.col("source") == F.col("target"), ab / (ab + 1)).otherwise((ab - ba) / (ab + ba + 1))
    return e.select("source", "target", "frequency", F.round(value, 6).alias("dependency")).withColumn("kept", F.col("dependency") >= dependency)


def loops_of_two(log: EventLog) -> DataFrame:
    """(a, b, frequency, dependency): how often a b a occurs, and the loop-of-two measure."""
    w = log.in_case
    rows = log.events.select(F.col("activity").alias("a"), F.lead("activity", 1).over(w).alias("b"), F.lead("activity", 2).over(w).alias("c"))
    rows = rows.where((F.col("a") == F.col("c")) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("frequency"))
    back = rows.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("frequency").alias("reverse"))
    rows = rows.join(back, ["a", "b"], "left").withColumn("reverse", F.coalesce("reverse", F.lit(0)))
    total = F.col("frequency") + F.col("reverse")
    return rows.select("a", "b", "frequency", F.round(total / (total + 1), 6).alias("dependency"))


#: The driver holds the edges between at most this many activities.
MAX_DRAWN = 2_000


def visible_dfg(log: EventLog, node_pct: float = 1.0, edge_pct: float = 1.0) -> DataFrame:
    """Edges to draw: the most frequent share of nodes and edges, with a maximum spanning forest of the kept nodes.

    A drawing has at most 2,000 activities; more are an error.
    """
    nodes = dfg_nodes(log).orderBy(F.desc("frequency"), F.asc("activity"))
    names = [r["activity"] for r in nodes.limit(MAX_DRAWN + 1).collect()]
    if len(names) > MAX_DRAWN:
        raise ValueError(f"more than {MAX_DRAWN} activities")
    names = set(names[: max(1, round(node_pct * len(names)))])
    edges = [r for r in edge_counts(log).orderBy(F.desc("frequency"), "source", "target").collect() if r["source"] in names and r["target"] in names]
    parent = {n: n for n in names}

    def root(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    kept = []
    for k, e in enumerate(edges):
        a, b = root(e["source"]), root(e["target"])
        tree = a != b
        parent[max(a, b)] = min(a, b)
        if tree or k < max(1, round(edge_pct * len(edges))):
            kept.append((e["source"], e["target"], e["frequency"], tree))
    return log.df.sparkSession.createDataFrame(kept, "source string, target string, frequency long, in_tree boolean")
