"""Centroid clustering with Hamerly's bounds, in exact integers.

Vectors become integers floor(SCALE * x). Each round assigns every vector to its nearest
centroid (squared Euclidean distance, ties to the smaller number) and then moves every
centroid that has vectors to the floor of their mean.

Each vector carries an upper bound of the distance to its own centroid and one lower bound of
the distance to the second nearest. When centroids move, the upper bound grows by the
own centroid's drift and the lower one shrinks by the largest drift of another. While the
upper bound stays below the lower one, or below half the distance from the own centroid
to the next one, no other centroid can be as near and nothing is computed. Otherwise the
upper bound is made exact; what is still ambiguous is compared with all centroids in
integers. Bounds are doubles with a margin for rounding, so results are those of full scans.

Scale. A round is one narrow pass over the vectors with k centroids of bounded size in its
closure. Only vectors that moved enter the sums: sums by cluster and component
per task are shuffled and k rows of them reach the driver, as whole numbers of any size. The integers are a table in
shared storage; a round's rows are persisted (memory and disk) until the next round has
them, and a lost executor's share is computed again from the table by narrow steps.

Defined results: vectors that are null, of another length, or hold null or non-finite
components are left out; with fewer than k vectors there are as many centroids; repeated
rows are vectors each; rows without an id take part, last in the order of the first
centroids; equal digests are ordered by vector; an empty table gives an empty result;
further columns are ignored. A component beyond 2**27 in integers raises an error, as
distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import materialize, table

K, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
LARGEST = 2**27
#: Relative margin of the bounds, far above what rounding of a few operations can add up to.
MARGIN = 1e-12

_STATE = "vec_id long, x array<int>, cluster int, was int, upper double, lower double, scans int"


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that can be clustered."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v * scale))
    rows = vectors.where(F.coalesce((F.size(x) == dim) & sound, F.lit(False)))
    large = F.exists("x", lambda v: F.abs(v) > LARGEST)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))
    fits = F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("x"))
    return rows.select("vec_id", fits.cast("array<int>").alias("x"))


def first_centroids(points: DataFrame, k: int = K, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


class Round:
    """Centroids of a round and how far they have moved since the last one."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64))
        self.drift = moved * (1 + MARGIN)
        # The largest drift of any other centroid.
        self.others = np.array([max((d for j, d in enumerate(self.drift) if j != c), default=0.0) for c in range(len(centroids))])
        gaps = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(axis=1) / 2 * (1 - MARGIN) if len(centroids) else gaps

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to all centroids."""
        return np.stack([((x - c) ** 2).sum(axis=1) for c in self.centroids], axis=1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bring clusters and bounds up to this round, in place; where all centroids were compared."""
        known = cluster >= 0
        upper += self.drift[cluster]
        upper *= 1 + MARGIN
        lower -= self.others[cluster]
        lower -= np.abs(lower) * MARGIN
        bar = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(~known | (upper >= bar))
        own = ((x[open_] - self.centroids[cluster[open_]]) ** 2).sum(axis=1)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + MARGIN)
        open_ = open_[~known[open_] | (upper[open_] >= bar[open_])]
        if len(open_):
            far = self.distances(x[open_])
            best = far.argmin(axis=1)
            cluster[open_] = best
            upper[open_] = np.sqrt(far[np.arange(len(far)), best].astype(np.float64)) * (1 + MARGIN)
            far[np.arange(len(far)), best] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(far.min(axis=1).astype(np.float64)) * (1 - MARGIN)
        return open_


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(rows, -1)


def _assigned(state: DataFrame, turn: Round) -> DataFrame:
    """state after one assignment; was is the cluster before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was, cluster, upper, lower, scans = (batch.column(c).to_numpy().copy() for c in ("cluster", "cluster", "upper", "lower", "scans"))
            scans[turn.assign(_matrix(batch.column("x"), batch.num_rows), cluster, upper, lower)] += 1
            columns = [batch.column("vec_id"), batch.column("x"), *map(pa.array, (cluster, was, upper, lower, scans))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "was", "upper", "lower", "scans"])

    return state.mapInArrow(run, _STATE)


def _measured(state: DataFrame, turn: Round) -> DataFrame:
    """(vec_id, cluster, distance, scans) with exact squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, cluster = _matrix(batch.column("x"), batch.num_rows), batch.column("cluster").to_numpy()
                far = ((x - turn.centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(far), batch.column("scans")], names=["vec_id", "cluster", "distance", "scans"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, scans int")


def _changes(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """By cluster: the sum of the components of vectors that it gained less those it lost, and last their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            cluster, was = batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
            moved = np.flatnonzero(cluster != was)
            if len(moved):
                x = np.column_stack((_matrix(batch.column("x"), batch.num_rows)[moved], np.ones(len(moved), np.int64)))
                for c in range(k):
                    sums[c] += x[cluster[moved] == c].sum(axis=0) - x[was[moved] == c].sum(axis=0)
        c, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[c, i])], names=["c", "i", "s"])

    rows = state.select("x", "cluster", "was").mapInArrow(run, "c int, i int, s long")
    out = np.zeros((k, dim + 1), object)
    for r in rows.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["c"], r["i"]] = int(r["s"])
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, scans) of every vector that can be clustered, and the final centroids."""
    points = materialize(integers(vectors, dim, scale), "centroid-points")
    centroids = first_centroids(points, k)
    none = F.lit(0.0)
    state = points.select("vec_id", "x", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), none.alias("upper"), none.alias("lower"), F.lit(0).alias("scans"))
    if not len(centroids):
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), "scans"), []
    totals = np.zeros((len(centroids), dim + 1), object)
    turn, held = Round(centroids), None
    for _ in range(rounds):
        state = _assigned(state, turn).persist(StorageLevel.MEMORY_AND_DISK)
        totals = totals + _changes(state, len(centroids), dim)
        if held is not None:
            held.unpersist()
        held = state
        after = [[s // n for s in total] if n else old for (*total, n), old in zip(totals.tolist(), turn.centroids.tolist(), strict=True)]
        turn = Round(np.array(after, np.int64), turn.centroids)
    done = materialize(_measured(_assigned(state, turn), turn), "centroid-clusters")
    if held is not None:
        held.unpersist()
    return done, turn.centroids.tolist()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def _oracle() -> str:
    far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "pts AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "px AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(x) AS v FROM pts)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM pts ORDER BY h, x LIMIT 8))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, vec_id, c, d FROM (SELECT p.r, p.vec_id, c.c, {far} AS d FROM pts p, c{k} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < ROUNDS:
            steps.append(
                f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{k} o LEFT JOIN (SELECT c, list(v ORDER BY i) AS x FROM "
                f"(SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT a.c, i, sum(v) AS s, count(*) AS n FROM a{k} a JOIN px USING (r) GROUP BY a.c, i)) GROUP BY c) n USING (c))"
            )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (c)"
    )


ORACLE = _oracle()
