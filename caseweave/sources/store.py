"""Stored logs with versions: snapshots under a manifest that is added to last, edits with an audit, and results by fingerprint.

A store is a folder in shared storage. Every version is a snapshot of its own (events, cases and the audit of its
edits); a row of the manifest names it, and is written, as one file, only when the snapshot is complete. So
a reader sees the old version or the new one, one that has begun keeps its snapshot, and
a writer that fails leaves no version behind. Two writers that begin from the same version cannot
both succeed. Results of operators are kept under a digest of snapshot, operator, filter and parameters: a second
call reads them, and a new version does not find them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.log import REQUIRED, EventLog
from caseweave.operators import access

#: Edits of these fields put rows in another place.
ORDER = ("case_id", "timestamp", "seq")
MANIFEST = "version long, parent long, snapshot string, note string, created_at timestamp, events long, cases long, min_timestamp timestamp_ntz, max_timestamp timestamp_ntz"
AUDIT = "row_index long, field string, old_value string, new_value string, new_row_index long"


class Conflict(RuntimeError):
    """Another writer has made a version from the same one."""


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at a path, or None where there is none yet."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: one row a version."""
    found = _read(spark, f"{root}/manifest", MANIFEST)
    return spark.createDataFrame([], MANIFEST) if found is None else found


def latest(spark: SparkSession, root: str, version: int | None = None):
    """The manifest row of a version, by default the last; None where there is none."""
    rows = versions(spark, root)
    rows = rows if version is None else rows.where(F.col("version") == version)
    return rows.orderBy(F.desc("version"), "snapshot").first()


def read(spark: SparkSession, root: str, version: int | None = None) -> EventLog:
    """The log of a version; it stays what it is while others write."""
    row = latest(spark, root, version)
    if row is None:
        raise ValueError(f"no such version in {root}")
    return EventLog(spark.read.parquet(f"{root}/{row['snapshot']}/events"))


def _commit(spark: SparkSession, root: str, events: DataFrame, parent: int, note: str, audit: DataFrame | None) -> int:
    name = f"snapshot-{uuid.uuid4().hex}"
    stored = events.repartition("case_id").sortWithinPartitions(*ORDER[:2], "seq")
    stored.write.option("compression", "zstd").parquet(f"{root}/{name}/events")
    log = EventLog(spark.read.parquet(f"{root}/{name}/events"))
    access.cases(log).write.option("compression", "zstd").parquet(f"{root}/{name}/cases")
    if audit is not None:
        # New places are looked up in what was written.
        places = access.indexed(log).where(F.col("cw_old").isNotNull()).select(F.col("cw_old").alias("row_index"), F.col("row_index").alias("new_row_index"))
        audit.join(places, "row_index").write.parquet(f"{root}/{name}/audit")
    else:
        spark.createDataFrame([], AUDIT).write.parquet(f"{root}/{name}/audit")
    bounds = log.df.agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases"), F.min("timestamp").cast("timestamp_ntz").alias("min_timestamp"), F.max("timestamp").cast("timestamp_ntz").alias("max_timestamp"))
    row = bounds.select(F.lit(parent + 1).cast("long").alias("version"), F.lit(parent).cast("long").alias("parent"), F.lit(name).alias("snapshot"), F.lit(note).alias("note"), F.current_timestamp().alias("created_at"), "*")
    if (latest(spark, root) or {"version": 0})["version"] != parent:
        raise Conflict(f"version {parent} is no longer the last")
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    if latest(spark, root, parent + 1)["snapshot"] != name:
        raise Conflict(f"another version {parent + 1} came first")
    return parent + 1


def write(log: EventLog, root: str, note: str = "") -> int:
    """A log as the next version of a store; its number, from 1."""
    spark = log.df.sparkSession
    parent = (latest(spark, root) or {"version": 0})["version"]
    return _commit(spark, root, log.df.drop("cw_old"), parent, note, None)


def edit(spark: SparkSession, root: str, edits: DataFrame, note: str = "", version: int | None = None) -> int:
    """The next version, with cells changed; edits is (position, row_index, field, value as text).

    row_index is a row's place by case and time (`access.indexed`), from 0. Of several edits of a cell the one of
    highest position counts. Values are cast to their column's type. A row outside the log, an
    unknown field, a value that cannot be cast, or an empty required field raises, and makes no version. With
    version, another writer's newer one is a conflict.
    """
    row = latest(spark, root)
    if row is None:
        raise ValueError(f"no log in {root}")
    if version is not None and row["version"] != version:
        raise Conflict(f"version {version} is no longer the last")
    log = EventLog(spark.read.parquet(f"{root}/{row['snapshot']}/events").drop("cw_old"))
    names = log.df.columns
    fields = sorted(r["field"] for r in edits.select("field").distinct().limit(len(names) + 1).collect())
    if unknown := [f for f in fields if f not in names]:
        raise ValueError(f"unknown fields: {unknown}")
    if edits.where((F.col("row_index") < 0) | (F.col("row_index") >= row["events"]) | F.col("row_index").isNull()).limit(1).count():
        raise IndexError(f"rows are numbered from 0 to {row['events'] - 1}")
    last = edits.groupBy("row_index", "field").agg(F.max_by("value", "position").alias("value"))
    by_row = last.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("cw_edits"))
    rows = access.indexed(log).join(by_row, "row_index", "left")
    hit = lambda f: F.coalesce(F.map_contains_key("cw_edits", F.lit(f)), F.lit(False))
    text = lambda f: F.element_at("cw_edits", F.lit(f))
    bad = [hit(f) & ((text(f).isNotNull() & text(f).try_cast(log.df.schema[f].dataType).isNull()) | (text(f).isNull() if f in REQUIRED else F.lit(False))) for f in fields]
    if bad and rows.where(F.exists(F.array(*bad), lambda x: x)).limit(1).count():
        raise ValueError("a value does not fit its column, or a required field would be empty")
    new = {f: F.when(hit(f), text(f).try_cast(log.df.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    audit = rows.where(F.col("cw_edits").isNotNull()).select(
        "row_index", F.explode(F.array(*(F.when(hit(f), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), text(f).alias("new_value"))) for f in fields))).alias("x")
    )
    audit = audit.where("x is not null").select("row_index", "x.*")
    changed = rows.select(*(new.get(c, F.col(c)).alias(c) for c in names), F.when(F.col("cw_edits").isNotNull(), F.col("row_index")).alias("cw_old"))
    return _commit(spark, root, changed, row["version"], note, audit)


def audit(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """What the edits of a version changed: place before and after, field, old and new value."""
    row = latest(spark, root, version)
    return spark.read.schema(AUDIT).parquet(f"{root}/{row['snapshot']}/audit")


def fingerprint(snapshot: str, operator: str, view: Column | None, params: dict) -> str:
    """What a result depends on, as a digest."""
    parts = [snapshot, operator, None if view is None else str(view), sorted((k, repr(v)) for k, v in params.items())]
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()


def result(spark: SparkSession, root: str, operator: Callable[..., DataFrame], view: Column | None = None, version: int | None = None, **params) -> DataFrame:
    """operator(log, **params) on a version under a filter, read from the store where it was computed before.

    The operator's module and name stand for it; what it returns must depend on nothing else.
    """
    row = latest(spark, root, version)
    if row is None:
        raise ValueError(f"no such version in {root}")
    name = f"{operator.__module__}.{operator.__qualname__}"
    path = f"{root}/results/{fingerprint(row['snapshot'], name, view, params)}"
    held = _read(spark, path)
    if held is None:
        log = EventLog(spark.read.parquet(f"{root}/{row['snapshot']}/events").drop("cw_old"), view)
        operator(log, **params).write.mode("overwrite").parquet(path)
        entry = [(row["snapshot"], row["version"], name, path.rpartition("/")[2])]
        spark.createDataFrame(entry, "snapshot string, version long, operator string, digest string").coalesce(1).write.mode("append").parquet(f"{root}/results-index")
        held = spark.read.parquet(path)
    return held


def stored_results(spark: SparkSession, root: str) -> DataFrame:
    """(version, operator, results, current): stored results by version and operator, and whether they are of the last version."""
    held = _read(spark, f"{root}/results-index")
    if held is None:
        held = spark.createDataFrame([], "snapshot string, version long, operator string, digest string")
    last = (latest(spark, root) or {"version": None})["version"]
    return held.groupBy("version", "operator").agg(F.count_distinct("digest").alias("results")).withColumn("current", F.coalesce(F.col("version") == F.lit(last), F.lit(False)))
