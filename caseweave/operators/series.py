"""Constraint series over windows: how they are measured, grouped by shape, and where they change."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import drift
from caseweave.operators.resources import redundant_series


def response_series(log: EventLog, n_windows: int = 50) -> DataFrame:
    """(constraint, pos, value): for pairs of activities, the percentage of events of the first that the second follows, by window of traces.

    An event is followed by what its case does later, which the last place of each activity in the
    case tells; so events meet one row an activity, not one another. Windows without the first
    activity have 0; pairs that never occur in this order have no series.
    """
    rows = log.sequenced().select("case_id", "activity", "pos").join(drift.trace_windows(log, n_windows).select("case_id", "window"), "case_id")
    last = rows.groupBy("case_id", F.col("activity").alias("then")).agg(F.max("pos").alias("last"))
    met = rows.join(last, "case_id").where("last > pos").groupBy("window", "activity", "then").agg(F.count("*").alias("n"))
    total = rows.groupBy("window", "activity").agg(F.count("*").alias("total"))
    share = met.join(total, ["window", "activity"]).select("activity", "then", F.col("window").alias("pos"), F.round(100.0 * F.col("n") / F.col("total"), 6).alias("value"))
    grid = share.select("activity", "then").distinct().select("activity", "then", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("pos"))
    whole = grid.join(share, ["activity", "then", "pos"], "left")
    return whole.select(F.concat_ws("→", "activity", "then").alias("constraint"), "pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def ward(points: np.ndarray, cutoff: float) -> np.ndarray:
    """Cluster number (from 0, by first member) of each row: Ward's linkage, cut where merging costs more than cutoff.

    Nearest-neighbour chain: heights of Ward's linkage never fall along a chain, so any two rows that are
    nearest to each other may be merged in any order.
    """
    n = len(points)
    centre, size, alive = points.astype(float).copy(), np.ones(n), np.ones(n, bool)
    root = np.arange(n)
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        d = np.sqrt(2 * size[a] * size / (size[a] + size) * ((centre - centre[a]) ** 2).sum(axis=1))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            if d[b] > cutoff:
                # Everything nearest to these two lies further off: they are done.
                alive[[a, b]] = False
                continue
            centre[b] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
            size[b] += size[a]
            alive[a] = False
            root[root == a] = b
        else:
            chain.append(b)
    first: dict[int, int] = {}
    return np.array([first.setdefault(r, len(first)) for r in root.tolist()])


def clusters(series: DataFrame, cutoff: float = 300.0) -> DataFrame:
    """(constraint, cluster): series (constraint, pos, value) of equal length that change, grouped by Ward's linkage and numbered by size.

    One row a series is gathered, so this is for as many series as there are pairs of activities, not cases.
    """
    flat = redundant_series(series)
    rows = series.join(flat.where(~F.col("redundant")).select("constraint"), "constraint", "left_semi")
    rows = rows.groupBy("constraint").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("values"))

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("constraint").reset_index(drop=True)
        return pd.DataFrame({"constraint": part["constraint"], "found": ward(np.stack(part["values"].tolist()), cutoff)})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(group, "constraint string, found int")
    sizes = found.groupBy("found").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "found"))
    return found.join(F.broadcast(sizes.select("found", rank.alias("cluster"))), "found").select("constraint", "cluster")


class KernelCost:
    """Cost of segments of a signal (time by series) under a Gaussian kernel of median width, from prefix sums."""

    def __init__(self, signal: np.ndarray):
        square = ((signal[:, None, :] - signal[None, :, :]) ** 2).sum(axis=2)
        apart = square[np.triu_indices(len(signal), 1)]
        middle = np.median(apart) if len(apart) else 0.0
        kernel = np.exp(-np.clip(square / middle if middle > 0 else square, 1e-2, 1e2))
        np.fill_diagonal(kernel, 1.0)
        self.sums = np.zeros((len(signal) + 1, len(signal) + 1))
        self.sums[1:, 1:] = kernel.cumsum(axis=0).cumsum(axis=1)

    def __call__(self, a: int, b: int) -> float:
        s = self.sums
        return (b - a) - (s[b, b] - s[a, b] - s[b, a] + s[a, a]) / (b - a)


def pelt(cost, n: int, penalty: float, least: int = 2, step: int = 1, prune: bool = True) -> list[int]:
    """Ends of the segments (the last is n) that minimise their costs plus penalty for each, by dynamic programming.

    A start that cannot pay for itself at one end cannot at a later one, and is dropped.
    """
    best, came, starts = {0: -penalty}, {0: 0}, [0]
    for end in [e for e in range(0, n, step) if e >= least] + [n]:
        options = {a: best[a] + cost(a, end) + penalty for a in starts if end - a >= least}
        if not options:
            continue
        came[end] = min(options, key=options.get)
        best[end] = options[came[end]]
        if prune:
            starts = [a for a in starts if a not in options or options[a] <= best[end] + penalty]
        starts.append(end)
    out, at = [], n
    while at:
        out.append(at)
        at = came.get(at, 0)
    return out[::-1]


def changes(signal: np.ndarray, penalty: float = 50.0, most: int = 15, least: int = 2, step: int = 2) -> list[int]:
    """Change points with the largest penalty, from `penalty` down by ones, that is below the number of segments; only the end if there are more than `most`."""
    if len(signal) < 2 * least:
        return [len(signal)]
    cost = KernelCost(signal)
    ends = pelt(cost, len(signal), penalty, least, step)
    while penalty >= len(ends):
        penalty -= 1
        ends = pelt(cost, len(signal), penalty, least, step)
    return ends if len(ends) <= most else ends[-1:]


def change_points(series: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """(cluster, change): places at which the series (constraint, pos, value) of a cluster change together, the end included; a cluster is one task."""
    if grouped is None:
        grouped = series.select("constraint", F.lit(0).alias("cluster")).distinct()

    def find(part: pd.DataFrame) -> pd.DataFrame:
        signal = part.pivot_table(index="pos", columns="constraint", values="value", fill_value=0.0).sort_index().to_numpy()
        return pd.DataFrame({"cluster": int(part["cluster"].iloc[0]), "change": changes(signal)})

    return series.join(grouped, "constraint").groupBy("cluster").applyInPandas(find, "cluster int, change int")
