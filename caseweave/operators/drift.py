"""Concept drift over windows of traces, and retrieval of context for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import time_ranked
from caseweave.log import EventLog


def trace_windows(log: EventLog, n_windows: int) -> DataFrame:
    """(case_id, window): traces by first event in windows of equal count, the last one takes the rest."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    size = F.greatest(F.floor(F.col("total") / n_windows), F.lit(1))
    at = F.least(F.floor((F.col("rank") - 1) / size), F.lit(n_windows - 1)).cast("int")
    return time_ranked(t, "start", "case_id").select("case_id", "start", at.alias("window"))


def drift_windows(log: EventLog, n_windows: int = 50) -> DataFrame:
    """Directly-follows counts of each window."""
    e = log.edges().join(trace_windows(log, n_windows).select("case_id", "window"), "case_id")
    return e.groupBy("window", "source", "target").agg(F.count("*").alias("frequency"))


def drift_similarity(log: EventLog, n_windows: int = 50) -> DataFrame:
    """(i, j, value): cosine distances of window counts as 0..255, 255 for equal, scaled by the largest distance.

    Windows meet on shared edges. An empty window is at distance 1 from every other.
    """
    spark = log.df.sparkSession
    f = drift_windows(log, n_windows)
    norms = f.groupBy("window").agg(F.sqrt(F.sum(F.col("frequency") * F.col("frequency")).cast("double")).alias("norm"))
    a = f.select(F.col("window").alias("i"), "source", "target", F.col("frequency").alias("x"))
    b = f.select(F.col("window").alias("j"), "source", "target", F.col("frequency").alias("y"))
    dots = a.join(b, ["source", "target"]).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    ids = spark.range(n_windows).select(F.col("id").cast("int").alias("i"))
    grid = ids.crossJoin(F.broadcast(ids.withColumnRenamed("i", "j")))
    n = lambda c: F.broadcast(norms.select(F.col("window").alias(c), F.col("norm").alias(f"norm_{c}")))
    rows = grid.join(dots, ["i", "j"], "left").join(n("i"), "i", "left").join(n("j"), "j", "left")
    cos = F.coalesce(F.col("dot") / F.nullif(F.col("norm_i") * F.col("norm_j"), F.lit(0.0)), F.lit(0.0))
    rows = rows.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.round(1 - cos, 12)).alias("d"))
    top = F.max("d").over(Window.partitionBy())
    scaled = F.when(top > 0, 1 - F.col("d") / top).otherwise(1.0)
    return rows.select("i", "j", F.floor(F.round(scaled * 255, 6)).cast("int").alias("value"))


def drift_frobenius(log: EventLog, n_windows: int = 50) -> DataFrame:
    """(i, j, distance) for i < j: Euclidean distance of two windows' counts, from norms and shared edges."""
    f = drift_windows(log, n_windows)
    norms = f.groupBy("window").agg(F.sum(F.col("frequency") * F.col("frequency")).alias("sq"))
    a = f.select(F.col("window").alias("i"), "source", "target", F.col("frequency").alias("x"))
    b = f.select(F.col("window").alias("j"), "source", "target", F.col("frequency").alias("y"))
    dots = a.join(b, ["source", "target"]).where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    n = lambda c: F.broadcast(norms.select(F.col("window").alias(c), F.col("sq").alias(f"sq_{c}")))
    pairs = n("i").crossJoin(n("j")).where("i < j").join(dots, ["i", "j"], "left")
    apart = F.col("sq_i") + F.col("sq_j") - 2 * F.coalesce("dot", F.lit(0))
    return pairs.select("i", "j", F.round(F.sqrt(apart.cast("double")), 6).alias("distance"))


def matrix_distance(a: np.ndarray, b: np.ndarray, norm: str) -> float:
    """Distance of two matrices: fro, nuc, inf, l2 norms of the difference, cos, or earth; the Frobenius norm where one is not defined.

    earth sums over rows the Wasserstein distance between the heights of the histograms (as samples) of
    their whole-number values below the number of columns.
    """
    gap = a - b
    if norm in ("nuc", "l2"):
        # Singular values are the roots of the eigenvalues of the smaller Gram matrix.
        values = np.sqrt(np.clip(np.linalg.eigvalsh(gap.T @ gap), 0.0, None))
        return float(values.sum() if norm == "nuc" else values.max(initial=0.0))
    if norm == "inf":
        return float(np.abs(gap).sum(axis=1).max(initial=0.0))
    if norm == "cos":
        size = np.linalg.norm(a) * np.linalg.norm(b)
        if size > 0:
            return float(1 - (a * b).sum() / size)
    if norm == "earth":
        heights = [np.array([np.bincount(r[(r >= 0) & (r < len(r))].astype(int), minlength=len(r)) for r in np.rint(m)], float) for m in (a, b)]
        if all(h.sum(axis=1).min(initial=1.0) > 0 for h in heights):
            x, y = (np.sort(h / h.sum(axis=1, keepdims=True), axis=1) for h in heights)
            return float(np.abs(x - y).mean(axis=1).sum())
    return float(np.sqrt((gap * gap).sum()))


NORMS = ("fro", "nuc", "inf", "l2", "cos", "earth")


def drift_norms(log: EventLog, n_windows: int = 50, norms: tuple[str, ...] = NORMS) -> DataFrame:
    """(i, j, norm, distance) for i < j: distances of the directly-follows matrices of two windows.

    A pair of windows is a group of at most the edges of both, and a matrix is as large as the activities.
    """
    f = drift_windows(log, n_windows)
    names = f.select(F.col("source").alias("activity")).union(f.select("target")).distinct()
    names = names.select("activity", (F.row_number().over(Window.orderBy("activity")) - 1).alias("k"))
    total = names.count()
    numbered = f.join(names.select(F.col("activity").alias("source"), F.col("k").alias("row")), "source").join(names.select(F.col("activity").alias("target"), F.col("k").alias("col")), "target")
    cells = numbered.groupBy("window").agg(F.collect_list(F.struct("row", "col", "frequency")).alias("cells"))
    ids = log.df.sparkSession.range(n_windows).select(F.col("id").cast("int").alias("window")).join(cells, "window", "left")
    side = lambda w, c: ids.select(F.col("window").alias(w), F.col("cells").alias(c))
    others = side("i", "x").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    pairs = others.where(F.col("i") < F.col("j")).join(side("j", "y"), "j").select("i", "j", "x", "y").repartition("i", "j")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def matrix(cells) -> np.ndarray:
            out = np.zeros((total, total))
            for c in cells if cells is not None else ():
                out[c["row"], c["col"]] = c["frequency"]
            return out

        for batch in batches:
            rows = [(i, j, n, round(matrix_distance(a, b, n), 6)) for i, j, a, b in ((i, j, matrix(x), matrix(y)) for i, j, x, y in batch.itertuples(index=False)) for n in norms]
            yield pd.DataFrame(rows, columns=["i", "j", "norm", "distance"])

    return pairs.mapInPandas(measure, "i int, j int, norm string, distance double")


def dominant_activity(log: EventLog, n_windows: int) -> DataFrame:
    """The most frequent activity of each chunk of rows in time order; ties by name."""
    size = F.greatest(F.floor(F.col("total") / n_windows), F.lit(1))
    at = F.least(F.floor((F.col("rank") - 1) / size), F.lit(n_windows - 1)).cast("int")
    rows = time_ranked(log.events.select("activity", "timestamp", "seq"), "timestamp", "seq").select("activity", at.alias("window"))
    counts = rows.groupBy("window", "activity").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("n"), F.asc("activity")))
    return counts.withColumn("k", place).where("k = 1").select("window", "activity", "n")


def sliding_windows(log: EventLog, size: int = 100, step: int = 50) -> DataFrame:
    """(window, start): first time of sliding windows of traces."""
    t = log.events.groupBy("case_id").agg(F.min("timestamp").alias("start"))
    t = time_ranked(t, "start", "case_id").select("start", (F.col("rank") - 1).alias("k"), F.col("total").alias("n"))
    return t.where((F.col("k") % step == 0) & (F.col("k") < F.col("n") - size)).select((F.col("k") / step).cast("int").alias("window"), "start")


def nearest_before(dates: DataFrame, pivot, date: str = "start", key: str = "case_id") -> DataFrame:
    """The row with the latest date at or before the pivot, the first by key on ties."""
    return dates.where(F.col(date) <= F.lit(pivot)).orderBy(F.desc(date), key).limit(1)


def vector_topk(vectors: DataFrame, query: list[float], k: int, where=None) -> DataFrame:
    """The k vectors of highest cosine with a query vector; ties by id."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    e = F.transform("embedding", lambda v: v.cast("double"))
    dot = total(F.zip_with(e, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(e, lambda v: v * v))) * F.sqrt(total(F.transform(q, lambda v: v * v)))
    score = F.round(F.when(norm > 0, dot / norm).otherwise(0.0), 9)
    return rows.select("vec_id", "label", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """One hit per (source, text), the one of highest score."""
    return hits.groupBy("source", "text").agg(F.max("score").alias("score"))


def rerank(hits: DataFrame, document: str, specificity: str, similarity: str, first: int = 20, last: int = 4) -> DataFrame:
    """Hits by 0.4 specificity + 0.6 similarity, the best of each document, `first` of which go on and `last` stay."""
    rows = hits.withColumn("rank_score", F.round(0.4 * F.col(specificity) + 0.6 * F.col(similarity), 9))
    w = Window.partitionBy(document).orderBy(F.desc("rank_score"), F.asc("vec_id"))
    rows = rows.withColumn("cw_k", F.row_number().over(w)).where("cw_k = 1").drop("cw_k")
    rows = rows.orderBy(F.desc("rank_score"), "vec_id").limit(first)
    return rows.orderBy(F.desc("rank_score"), "vec_id").limit(last)


def in_period(docs: DataFrame, start, end, before_days: int, after_days: int, date: str = "timestamp") -> DataFrame:
    """Rows dated from `before_days` before start to `after_days` after end; all rows where there is none."""
    lo = F.lit(start).cast("timestamp_ntz") - F.make_dt_interval(F.lit(before_days))
    hi = F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(after_days))
    near = docs.where(F.col(date).between(lo, hi))
    return docs if near.isEmpty() else near


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Overlapping pieces of a text: doc_id, chunk number, chunk."""
    n = F.length(F.coalesce("text", F.lit("")))
    last = F.greatest(F.ceil((n - overlap) / (size - overlap)).cast("int") - 1, F.lit(0))
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * (size - overlap) + 1, F.lit(size)).alias("chunk"))
