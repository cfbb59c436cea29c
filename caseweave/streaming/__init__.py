"""Incremental ingest and edits by Structured Streaming and rewrites.

`follow` reads new files of a folder as a stream, keeps each event once and stores
it by batch; `sessions` keeps usage sessions as state; `arrivals` and `live_cases` are windowed
aggregations under a watermark; `edit` applies cell edits with an audit trail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.log import EventLog

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


def watch(spark: SparkSession, folder: str, kind: str = "csv", schema: T.StructType = EVENT_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; a path is read once."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("header", True) if kind == "csv" else reader).load(folder)


def once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events with re-deliveries dropped while they arrive within the delay."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["case_id", "activity", "timestamp", "seq"])


def _part(target: str, checkpoint: str, k: int) -> str:
    """Where a stream's batch goes: replayed, it takes the same place."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return f"{target.rstrip('/')}/source={source}/batch={k}"


def follow(stream: DataFrame, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, mode: str = "append"):
    """Add a stream to Parquet, all that is there now; `after` sees each batch, say to recompute touched cases.

    Each batch of a checkpoint overwrites a partition of its own, so one that is replayed after a failure
    is stored once. Streams with checkpoints of their own may share a target. State that goes on
    changing, as of `sessions`, takes mode="update".
    """

    def batch(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(_part(target, checkpoint, k))
        if after:
            after(df, k)

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


USAGE_SCHEMA = T.StructType(
    [
        T.StructField("delivery", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("occurred_at", T.TimestampType()),
    ]
)
_SESSION = "session_id string, user_id string, started_at timestamp, last_seen timestamp, events long, closed boolean"
_STATE = "user_id string, started_at timestamp, last_seen timestamp, events long, deliveries array<string>"


def sessions(stream: DataFrame, idle: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions as they grow, from deliveries (delivery, session_id, user_id, started_at, occurred_at) of usage events.

    The first delivery of a session opens it, later ones add to it and move last_seen. A delivery that comes again
    while its session is open has no effect, nor has one under a session id of another user. A session closes
    when event time is `idle` past its last event; events further back than `delay` are too late and left out.
    State is kept by session, with the deliveries it has taken, and goes when it closes.
    """
    wait = pd.Timedelta(idle)

    def grow(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _session_row(key, row, True)
            return
        held, taken = row, 0
        seen = set(row[4]) if row else set()
        fresh = pd.concat(list(parts)).sort_values(["occurred_at", "user_id", "delivery"])
        fresh = fresh[~fresh["delivery"].isin(seen)]
        if held is None and len(fresh):
            first = fresh.iloc[0]
            held = [first["user_id"], first["started_at"], first["occurred_at"], 0, []]
        if held is not None:
            own = fresh[fresh["user_id"] == held[0]]
            taken = len(own)
        if taken:
            held[1] = min(pd.Timestamp(held[1]), own["started_at"].min())
            held[2] = max(pd.Timestamp(held[2]), own["occurred_at"].max())
            held[3] += taken
            held[4] = sorted(seen | set(own["delivery"]))
            state.update((held[0], pd.Timestamp(held[1]).to_pydatetime(), pd.Timestamp(held[2]).to_pydatetime(), int(held[3]), held[4]))
            yield _session_row(key, held, False)
        if state.exists:
            # Timeouts must lie past the watermark.
            due = int((pd.Timestamp(state.get[2]) + wait).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = stream.withWatermark("occurred_at", delay)
    return timed.groupBy("session_id").applyInPandasWithState(grow, _SESSION, _STATE, "update", "EventTimeTimeout")


def _session_row(key: tuple, row: list, closed: bool) -> pd.DataFrame:
    return pd.DataFrame({"session_id": [key[0]], "user_id": [row[0]], "started_at": [pd.Timestamp(row[1])], "last_seen": [pd.Timestamp(row[2])], "events": [int(row[3])], "closed": [closed]})


def current_sessions(spark: SparkSession, target: str) -> DataFrame:
    """The last state of each session that `follow` has stored."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("user_id", "started_at", "last_seen", "events", "closed"), F.struct("events", "last_seen", "closed")).alias("s"))
    return last.select("session_id", "s.*")


def touched_cases(log: DataFrame, batch: DataFrame) -> DataFrame:
    """All events of cases that a batch has touched."""
    return log.join(batch.select("case_id").distinct(), "case_id", "left_semi")


def arrivals(stream: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by tumbling window and activity, final once the watermark has passed."""
    return stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width), "activity").agg(F.count(F.lit(1)).alias("n"))


def live_cases(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Cases as sessions of events without a longer gap."""
    return stream.withWatermark("timestamp", delay).groupBy("case_id", F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("n_events"))


def changed_files(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, size, modified) that are new, or whose size or time differs from when they were seen."""
    old = seen.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    rows = listing.join(old, "path", "left")
    new = F.col("old_size").isNull() | (F.col("old_size") != F.col("size")) | (F.col("old_modified") != F.col("modified"))
    return rows.where(new).select("path", "size", "modified")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of a folder's files, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def edit(indexed: DataFrame, edits: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(log, audit): rows of `indexed` (with row_index) whose field takes edits' new value; audit holds old and new.

    edits is (row_index, value). Rewrite the log to another path than it is read from.
    """
    kind = indexed.schema[field].dataType
    rows = indexed.join(edits.select("row_index", F.col("value").alias("cw_new"), F.lit(True).alias("cw_hit")), "row_index", "left")
    audit = rows.where("cw_hit").select("row_index", F.lit(field).alias("field"), F.col(field).cast("string").alias("old_value"), F.col("cw_new").cast("string").alias("new_value"))
    value = F.when(F.col("cw_hit"), F.col("cw_new").cast(kind)).otherwise(F.col(field))
    return rows.withColumn(field, value).drop("cw_new", "cw_hit", "row_index"), audit


def edited_log(log: DataFrame) -> EventLog:
    """The edited rows as a log; its per-case order follows the edited times."""
    return EventLog(log)
