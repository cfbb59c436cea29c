"""Near-duplicate embeddings by NN-descent.

1. Vectors are normalised in double precision (after division by their largest
   component, so that none overflows) and equal ones collapsed to one vertex with a
   multiplicity. All comparisons are in double precision.
2. A first neighbour graph comes from random-hyperplane blocks: in each of `TABLES`
   hashings, vectors with the same signs meet in blocks, large blocks are dealt at
   random into chunks of bounded size, and each chunk finds the `k` nearest of each
   member by a matrix product.
3. NN-descent: each vertex gathers its neighbours and the vertices that list it (the
   latter in chunks where there are many). Entries are fresh for the round after they
   came in; pairs of which one is fresh are compared, and kept where they improve on
   one end's list. A vertex without fresh entries gathers nothing. Lists whose last
   entry is still a link are saturated: they double, up to `k_max`, and all their entries are
   fresh again. Of later rounds' entries only those that may lie next to a link
   (similarity above `1 - 4 (1 - threshold)`) are fresh, and none of a list of `k_max` links. Rounds go on until few entries
   within twice the threshold's distance change.
4. Edges at or above the threshold give connected components. A list that is still
   saturated at `k_max` may hold members of its own component only, so vertices with
   such lists are searched again with their own component left out, and components
   that turn out to be linked are joined, until a search finds no link that leaves one.
   A link missing from the lists of both of its ends has two saturated ends, so the
   others need not take part.
5. Audit: one vector in `AUDIT_SHARE`, drawn by hash over all of them, isolated ones included (at
   least `AUDIT_LEAST`, and at most `AUDIT_MOST`, which estimate a share within half a percent), is
   compared with all rows in batches of bounded size; another audit takes saturated ones. If fewer than `recall` of
   their true links lie inside one component, the search is repeated with wider lists
   and more rounds; if that fails, an error is raised.
6. Inside each component links are counted exactly by products of blocks, so a
   saturated list loses none, and no pair is ever emitted for it.

Everything is keyed by vertex, by chunk or by pair of blocks, each of bounded size;
the driver sees counts, and one batch of the audit's queries at a time.

Defined results: a null vector, one with null or non-finite components, the zero
vector and one of another length than its partner link with nothing and stand alone
(an empty one likewise); null ids are left out of the graph and returned with null
component and kept = true; rows that repeat an id count as copies of the smallest (in
array order) of its vectors that can link, and all get its result; an empty table gives an empty result; labels and further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import connected_components, materialize, table

THRESHOLD = 0.95
K, K_MAX = 8, 32
TABLES = 6
CHUNK = 256
ROUNDS = 6
AUDIT_SHARE, AUDIT_LEAST, AUDIT_MOST, AUDIT_BATCH = 100, 256, 16_384, 2_048
RECALL = 0.98
BLOCK = 4096
SETTLED = 0.002


def vertices(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit array<double>) of the rows that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    ids.append(vec_id)
                    units.append(x / np.sqrt((x * x).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "unit"]
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, unit array<double>")


def _slabs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """From batches sorted by key: rows of whole keys, and where each key begins and ends."""
    held: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> list[int]:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        return [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = cut(batch)
        held.append(batch)
        if len(edges) > 2 or held[0].column(key)[0] != batch.column(key)[0]:
            slab = pa.concat_batches(held)
            edges = cut(slab)
            yield slab.slice(0, edges[-2]), list(zip(edges[:-2], edges[1:-1], strict=True))
            held = [slab.slice(edges[-2])]
    if held:
        slab = pa.concat_batches(held)
        yield slab, [(0, slab.num_rows)]


class _Units:
    """The unit vectors of a slab, by range of rows of equal length."""

    def __init__(self, column: pa.Array):
        self.offsets = np.asarray(column.offsets)
        self.flat = np.asarray(column.values)

    def of(self, lo: int, hi: int) -> np.ndarray:
        return self.flat[self.offsets[lo] : self.offsets[hi]].reshape(hi - lo, -1)


_EDGES = "id long, nbr long, sim double, link boolean"


def _local(rows: DataFrame, key: str, k: int, threshold: float) -> DataFrame:
    """For each member of a key its k most similar others, as (id, nbr, sim, link).

    rows has key, id, unit, fresh (pairs of two old members are not compared), bar (only
    what is above it is kept) and own (members of one own are not compared; -1: of none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, groups in _slabs(batches, key):
            ids, fresh = slab.column("id").to_numpy(), slab.column("fresh").to_numpy(zero_copy_only=False)
            bar, own, units = slab.column("bar").to_numpy(), slab.column("own").to_numpy(), _Units(slab.column("unit"))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in groups:
                if hi - lo < 2:
                    continue
                order = np.lexsort((~fresh[lo:hi], ids[lo:hi]))
                names = ids[lo:hi][order]
                at = order[np.concatenate(([True], names[1:] != names[:-1]))]
                n = len(at)
                if n < 2:
                    continue
                x, new, home = units.of(lo, hi)[at], fresh[lo:hi][at], own[lo:hi][at]
                names = ids[lo:hi][at]
                sims = x @ x.T
                barred = ~(new[:, None] | new[None, :])
                np.fill_diagonal(barred, True)
                if home[0] >= 0 or home[-1] >= 0:
                    barred |= (home[:, None] == home[None, :]) & (home[:, None] >= 0)
                sims[barred] = -np.inf
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), (n, n))
                value = np.take_along_axis(sims, best, axis=1)
                good = value > bar[lo:hi][at][:, None]
                row = np.broadcast_to(np.arange(n)[:, None], best.shape)[good]
                found.append((names[row], names[best[good]], value[good]))
            if found:
                src, dst, sim = (np.concatenate(x) for x in zip(*found, strict=True))
                # Rounded, so that a pair met twice has one value; whether it is a link is decided before.
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim.round(9)), pa.array(sim >= threshold)], names=["id", "nbr", "sim", "link"])

    parts = rows.select(key, "id", "unit", "fresh", "bar", "own").repartition(F.col(key)).sortWithinPartitions(key)
    return parts.mapInArrow(run, _EDGES)


def _entries(edges: DataFrame) -> DataFrame:
    """(id, met): the entries of edges by id, nearest first."""
    entry = F.struct((-F.col("sim")).alias("far"), "nbr", "link", F.lit(True).alias("fresh"))
    return edges.groupBy("id").agg(F.array_sort(F.array_distinct(F.collect_list(entry))).alias("met"))


def _blocks(points: DataFrame, total: int, dim_seed: int) -> DataFrame:
    """points (id, unit, own) with the chunk they meet in for one hashing."""
    bits = max(0, int(np.ceil(np.log2(max(1, total / CHUNK)))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _Units(batch.column("unit"))
            sizes = np.diff(units.offsets)
            buckets = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                planes = np.random.default_rng([dim_seed, size]).standard_normal((size, bits))
                x = units.of(0, len(sizes)) if len(at) == len(sizes) else np.array([units.of(i, i + 1)[0] for i in at])
                buckets[at] = ((x @ planes > 0).astype(np.int64) << np.arange(bits)).sum(axis=1) + (size << 40)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "unit", "own")), pa.array(buckets)], names=["id", "unit", "own", "bucket"])

    hashed = points.select("id", "unit", "own").mapInArrow(run, "id long, unit array<double>, own long, bucket long")
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("id", F.lit(dim_seed)), F.ceil(F.col("n") / CHUNK))
    return hashed.join(sizes, "bucket").select("id", "unit", "own", F.xxhash64("bucket", salt, F.lit(dim_seed)).alias("chunk"))


def descend(
    points: DataFrame, k: int = K, k_max: int = K_MAX, rounds: int = ROUNDS, threshold: float = THRESHOLD, paths: DataFrame | None = None, seed: int = 0
) -> DataFrame:
    """The neighbour graph of points (id, unit), as (id, unit, own, near array<struct<far, nbr, link, fresh>>, size).

    Where points has a column own, members of one own are no neighbours; paths (id, nbr)
    are then further ways, inside them, by which vertices meet.
    """
    if "own" not in points.columns:
        points = points.withColumn("own", F.lit(-1).cast("long"))
    total = points.count()
    first = None
    for t in range(TABLES):
        met = _blocks(points, total, seed + t + 1).select("*", F.lit(True).alias("fresh"), F.lit(-2.0).alias("bar"))
        met = _local(met, "chunk", k, threshold)
        first = met if first is None else first.union(met)
    none = F.array().cast("array<struct<far:double,nbr:bigint,link:boolean,fresh:boolean>>")
    graph = points.join(_entries(first), "id", "left")
    graph = graph.select("id", "unit", "own", F.slice(F.coalesce("met", none), 1, k).alias("near"), F.lit(k).alias("size"))
    graph = materialize(graph, "nnd-0")
    next_to, about = 1 - 4 * (1 - threshold), 1 - 2 * (1 - threshold)
    for r in range(1, rounds + 1):
        ways = graph.select("id", F.explode("near").alias("e")).select("id", "e.nbr", "e.fresh")
        if paths is not None:
            ways = ways.union(paths.select("id", "nbr", F.lit(r == 1).alias("fresh")))
        # A vertex, its neighbours and the vertices that list it; those deal themselves into chunks where they are many.
        back = ways.select(F.col("nbr").alias("hub"), F.col("id").alias("at"), "fresh", F.lit(1).alias("listed"))
        ahead = ways.select(F.col("id").alias("hub"), F.col("nbr").alias("at"), "fresh", F.lit(0).alias("listed"))
        members = back.union(ahead)
        hubs = members.groupBy("hub").agg(F.greatest(F.ceil(F.sum("listed") / (4 * k)), F.lit(1)).alias("chunks"), F.max("fresh").alias("active"))
        hubs = materialize(hubs.where("active").drop("active"), f"nnd-hubs-{r}")
        by = F.when(F.col("listed") == 1, F.col("at")).otherwise(F.col("hub"))
        members = members.join(hubs, "hub").select("hub", F.pmod(F.xxhash64(by, F.lit(r)), F.col("chunks")).alias("salt"), "at", "fresh")
        own = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("salt"), F.col("hub").alias("at"), F.lit(False).alias("fresh"))
        bar = F.when(F.size("near") < F.col("size"), F.lit(-2.0)).otherwise(-F.element_at("near", -1)["far"])
        meet = members.union(own).withColumnRenamed("at", "id").join(graph.select("id", "unit", "own", bar.alias("bar")), "id")
        better = _local(meet.withColumn("chunk", F.xxhash64("hub", "salt")), "chunk", k_max, threshold)
        after = graph.join(_entries(better), "id", "left")
        known = F.transform("near", lambda e: e["nbr"])
        new = F.filter(F.coalesce("met", none), lambda e: ~F.array_contains(known, e["nbr"]))
        old = F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["nbr"].alias("nbr"), e["link"].alias("link"), F.lit(False).alias("fresh")))
        after = after.select("id", "unit", "own", F.slice(F.array_sort(F.concat(old, new)), F.lit(1), F.col("size")).alias("near"), "size")
        grows = (F.size("near") >= F.col("size")) & (F.col("size") < k_max) & F.element_at("near", -1)["link"]
        after = after.select("id", "unit", "own", "near", F.when(grows, F.least(2 * F.col("size"), F.lit(k_max))).otherwise(F.col("size")).alias("size"), grows.alias("grown"))
        # Better links for a full list of links lead nowhere new; what leaves its component is sought by itself.
        full = (F.size("near") >= k_max) & F.element_at("near", -1)["link"]
        again = lambda e: ~full & (F.col("grown") | (e["fresh"] & (e["far"] <= -next_to)))
        near = F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["nbr"].alias("nbr"), e["link"].alias("link"), again(e).alias("fresh")))
        graph = materialize(after.select("id", "unit", "own", near.alias("near"), "size"), f"nnd-{r}")
        count = lambda keep: F.coalesce(F.sum(F.size(F.filter("near", keep))), F.lit(0))
        row = graph.agg(count(lambda e: e["far"] <= -about).alias("all"), count(lambda e: e["fresh"] & (e["far"] <= -about)).alias("new")).first()
        if row["new"] <= SETTLED * row["all"]:
            break
    return graph


def audit(points: DataFrame, parts: DataFrame, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(true links, links inside one component) of query vectors drawn by hash from all points, against all of them."""
    placed = points.select("id", "unit").join(parts, "id", "left").select("id", "unit", F.coalesce("component", "id").alias("component"))
    placed = materialize(placed, "nnd-audit")
    asked = min(max(placed.count() // AUDIT_SHARE, AUDIT_LEAST), AUDIT_MOST)
    drawn = placed.select("id").orderBy(F.xxhash64("id"), "id").limit(asked)
    # Numbered, so that a batch is a range and the driver holds one at a time.
    drawn = materialize(drawn.select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-asked // AUDIT_BATCH))).alias("batch")), "nnd-asked")
    true = found = 0
    for k in range(-(-asked // AUDIT_BATCH)):
        lot = placed.join(F.broadcast(drawn.where(F.col("batch") == k).select("id")), "id").collect()
        one, inside = _audited(placed, lot, threshold)
        true, found = true + one, found + inside
    return true, found


def _audited(placed: DataFrame, lot: list, threshold: float) -> tuple[int, int]:
    """(true links, links inside one component) of the rows of one batch."""
    by_size: dict[int, list] = {}
    for row in lot:
        by_size.setdefault(len(row["unit"]), []).append(row)
    shared = placed.sparkSession.sparkContext.broadcast(
        {size: (np.array([r["id"] for r in rows]), np.array([r["component"] for r in rows]), np.array([r["unit"] for r in rows])) for size, rows in by_size.items()}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, home, units = batch.column("id").to_numpy(), batch.column("component").to_numpy(), _Units(batch.column("unit"))
            sizes = np.diff(units.offsets)
            true = found = 0
            for size in set(sizes.tolist()) & shared.value.keys():
                asked, homes, x = shared.value[size]
                at = np.flatnonzero(sizes == size)
                y = units.of(0, len(sizes)) if len(at) == len(sizes) else np.array([units.of(i, i + 1)[0] for i in at])
                near = (x @ y.T >= threshold) & (asked[:, None] != ids[at][None, :])
                true += int(near.sum())
                found += int((near & (homes[:, None] == home[at][None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([found])], names=["true", "found"])

    row = placed.select("id", "component", "unit").mapInArrow(run, "true long, found long").agg(F.sum("true").alias("n"), F.sum("found").alias("found")).first()
    shared.unpersist()
    return row["n"] or 0, row["found"] or 0


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): exact links inside each component; members has (component, id, unit, copies)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = members.join(sizes, "component")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = rows.withColumn("other", F.explode(others))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(F.xxhash64("component", lo, hi).alias("chunk"), "id", "copies", (F.col("block") == lo).alias("low"), (lo == hi).alias("own"), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, groups in _slabs(batches, "chunk"):
            ids, copies, units = slab.column("id").to_numpy(), slab.column("copies").to_numpy(), _Units(slab.column("unit"))
            low, own = slab.column("low").to_numpy(zero_copy_only=False), slab.column("own").to_numpy(zero_copy_only=False)
            links = np.zeros(len(ids), np.int64)
            for begin, end in groups:
                x, at, c = units.of(begin, end), np.arange(end - begin), copies[begin:end]
                side = low[begin:end]
                a, b = (at, at) if own[begin] else (at[side], at[~side])
                for part in range(0, len(a), 512):
                    rows_ = a[part : part + 512]
                    near = x[rows_] @ x[b].T >= threshold
                    if own[begin]:
                        near[np.arange(len(rows_)), rows_] = False
                    links[begin + rows_] += near @ c[b]
                    if not own[begin]:
                        links[begin + b] += c[rows_] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["id", "links"])

    parts = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "id long, links long")
    return parts.groupBy("id").agg(F.sum("links").alias("links"))


def _links(graph: DataFrame) -> DataFrame:
    """(src, dst): the entries of neighbour lists that are links."""
    rows = graph.select(F.col("id").alias("src"), F.explode(F.filter("near", lambda e: e["link"])).alias("e"))
    return rows.select("src", F.col("e.nbr").alias("dst"))


def _joined(points: DataFrame, graph: DataFrame, parts: DataFrame, k: int, k_max: int, rounds: int, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """parts after joining components that links of saturated vertices connect, and those vertices, if any."""
    last: Column = F.element_at("near", -1)
    full = materialize(graph.where((F.size("near") >= k_max) & last["link"]).select("id", "unit", "near"), "nnd-full")
    if full.isEmpty():
        return parts, None
    ids = full.select(F.col("id").alias("nbr"))
    # One link out of a component is enough to join it, so short lists do here.
    paths = full.select("id", F.explode(F.slice("near", 1, k)).alias("e")).select("id", "e.nbr")
    paths = materialize(paths.join(ids, "nbr").select("id", "nbr"), "nnd-paths")
    full = full.select("id", "unit")
    for turn in range(1, 200):
        rest = materialize(full.join(parts.withColumnRenamed("component", "own"), "id"), f"nnd-rest-{turn}")
        if rest.select("own").distinct().limit(2).count() < 2:
            return parts, full
        across = _links(descend(rest, k // 2, k, rounds, threshold, paths, turn * TABLES))
        of = lambda side, name: parts.select(F.col("id").alias(side), F.col("component").alias(name))  # noqa: B023, E731
        across = across.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        step = connected_components(across, f"nnd-join-{turn}")
        if step.isEmpty():
            return parts, full
        step = step.withColumnsRenamed({"component": "to", "id": "component"})
        parts = parts.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        parts = materialize(parts, f"nnd-joined-{turn}")
    raise RuntimeError("components of saturated lists did not settle")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    rows = vertices(vectors).groupBy("vec_id").agg(F.min("unit").alias("unit"), F.count("*").alias("n"))
    rows = materialize(rows, "nnd-rows")
    same = rows.groupBy("unit").agg(F.min("vec_id").alias("id"), F.sum("n").alias("copies"))
    points = materialize(same.select("id", "unit", "copies"), "nnd-points")
    k, rounds = K, ROUNDS
    for _ in range(3):
        k_max = max(4 * k, K_MAX)
        graph = descend(points.select("id", "unit"), k, k_max, rounds, threshold)
        parts = connected_components(_links(graph), "nnd-components")
        parts, full = _joined(points.select("id", "unit"), graph, parts, k, k_max, rounds, threshold)
        audits = [audit(some, parts, threshold) for some in (points, full) if some is not None]
        if all(found >= recall * true for true, found in audits):
            break
        k, rounds = 2 * k, rounds + 4
    else:
        raise RuntimeError(f"neighbour graph: too few of the audited links lie inside components: (true, found) {audits}")
    links = _counted(parts.join(points, "id"), threshold)
    done = points.select("id", "copies").join(parts, "id", "left").join(links, "id", "left")
    done = done.select(
        "id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    of = rows.join(points.select("unit", "id"), "unit").select("vec_id", "id")
    linked = of.join(done, "id").select("vec_id", "n_links", "component_id")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
