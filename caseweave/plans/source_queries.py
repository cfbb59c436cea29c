"""Round trips: the test tables written in a format, read again as a log, and summarised."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.log import EventLog
from caseweave.operators import access, ocel
from caseweave.operators import filters as flt
from caseweave.plans.tables import EV, OC, SE, by_session, by_user, object_log
from caseweave.sources import readers, writers


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares; a temporary one on a local master without such a folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="caseweave-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def _by_activity(log: EventLog) -> DataFrame:
    """Events, cases, and first and last millisecond of each activity."""
    ms = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    return log.events.groupBy("activity").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), ms(F.min("timestamp")).alias("first"), ms(F.max("timestamp")).alias("last"))


def _rows(log: EventLog) -> DataFrame:
    return log.events.select("case_id", "activity", "timestamp", "seq", "cost")


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """Roles by header, times from text, costs as numbers again."""
    path = _place(spark, "log.csv")
    writers.write_csv(_rows(by_user(spark, d)).withColumnsRenamed({"case_id": "Case ID", "activity": "Activity", "timestamp": "Timestamp", "cost": "Cost"}), path)
    log = readers.read_log(spark, path)
    return _by_activity(log).join(log.events.groupBy("activity").agg(F.round(F.sum("cost"), 2).alias("cost")), "activity")


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "log.ndjson")
    writers.write_ndjson(_rows(by_user(spark, d)), path)
    return _by_activity(readers.read_log(spark, path))


def _xes(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "log.xes")
    writers.write_xes(by_session(spark, d), path)
    return _by_activity(readers.read_log(spark, path))


def _xes_typed(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers, numbers, truth values, times and attributes of cases, by activity, as read back."""
    path = _place(spark, "log.xes")
    log = by_session(spark, d)
    rows = log.df.select("case_id", "activity", "timestamp", "seq", "resource", "cost", F.col("user_id").alias("number"), (F.col("cost") > 50).alias("dear"), (F.col("timestamp") + F.expr("INTERVAL 1 DAY")).alias("due"), (F.col("user_id") % 3).alias("case:group"))
    writers.write_xes(EventLog(rows), path)
    back = readers.read_log(spark, path).events
    assert {"number": "bigint", "dear": "boolean", "due": "timestamp_ntz", "case:group": "bigint", "cost": "double"}.items() <= dict(back.dtypes).items()
    return back.groupBy("activity").agg(
        F.sum("number").alias("numbers"), F.count_if("dear").alias("dear"), F.date_format(F.max("due"), "yyyy-MM-dd HH:mm:ss.SSS").alias("last_due"), F.sum("case:group").alias("groups"), F.round(F.sum("cost"), 2).alias("cost"), F.count_distinct("resource").alias("resources")
    )


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored form: events and cases as Parquet, with the counts of the manifest."""
    folder = _place(spark, "stored")
    meta = writers.write_log(by_session(spark, d), folder)
    cases = spark.read.parquet(f"{folder}/cases.parquet").agg(F.count("*").alias("cases_rows"), F.sum("event_count").cast("long").alias("events_rows"))
    return cases.select(F.lit(meta["events"]).cast("long").alias("events"), F.lit(meta["cases"]).cast("long").alias("cases"), "cases_rows", "events_rows")


def _object_tables(spark: SparkSession, d: str) -> DataFrame:
    folder = _place(spark, "objects")
    writers.write_object_log(object_log(spark, d), folder)
    return ocel.activity_types(readers.read_object_tables(spark, folder))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    page = access.events_page(by_user(spark, d), limit=50).select("case_id", "activity", "seq")
    return access.labelled(page, {"activity": "step", "seq": "number"}, ["seq", "activity"])


_ACTIVITY = (
    "SELECT activity, count(*) AS n, count(DISTINCT case_id) AS cases, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%g') AS first, "
    "strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%g') AS last"
)

QUERIES = {
    "csv_round_trip": _csv,
    "json_lines_round_trip": _json_lines,
    "xes_round_trip": _xes,
    "xes_typed_round_trip": _xes_typed,
    "stored_log": _stored,
    "object_tables_round_trip": _object_tables,
    "page_total": lambda s, d: access.page_total(by_user(s, d), flt.where([flt.Filter("activity", "contains", "CLI")], by_user(s, d).events.columns)),
    "labelled_page": _labelled,
}

ORACLE_SQL = {
    "csv_round_trip": f"WITH {EV} {_ACTIVITY}, round(sum(cost), 2) AS cost FROM ev GROUP BY activity",
    "json_lines_round_trip": f"WITH {EV} {_ACTIVITY} FROM ev GROUP BY activity",
    "xes_round_trip": f"WITH {SE} {_ACTIVITY} FROM ev GROUP BY activity",
    "xes_typed_round_trip": f"""WITH {SE} SELECT activity, CAST(sum(user_id) AS BIGINT) AS numbers, count(*) FILTER (WHERE cost > 50) AS dear, strftime(max(timestamp) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%g') AS last_due, CAST(sum(user_id % 3) AS BIGINT) AS groups, round(sum(cost), 2) AS cost, count(DISTINCT resource) AS resources FROM ev GROUP BY activity""",
    "stored_log": f"WITH {SE} SELECT count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) AS cases_rows, count(*) AS events_rows FROM ev",
    "object_tables_round_trip": f"WITH {OC} SELECT activity, type, count(DISTINCT eid) AS events, count(DISTINCT oid) AS objects FROM rel GROUP BY ALL",
    "page_total": f"WITH {EV} SELECT count(*) AS total FROM ev WHERE activity ILIKE '%CLI%'",
    "labelled_page": f"WITH {EV} SELECT seq AS number, activity AS step, case_id FROM ev ORDER BY ev.case_id, ev.timestamp, ev.seq LIMIT 50",
}
