"""The test tables as logs, in Spark and as SQL preludes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.log import EventLog, ObjectLog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_user(spark: SparkSession, sf_dir: str) -> EventLog:
    """Events with the user as the case."""
    return EventLog.from_table(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", seq="event_id", cost="value")


def by_session(spark: SparkSession, sf_dir: str) -> EventLog:
    """Events with a user's day as the case; resource is the user's number modulo 7."""
    rows = table(spark, sf_dir, "events").withColumn("resource", F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")))
    case = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return EventLog.from_table(rows, case, "event_type", "ts", seq="event_id", cost="value", resource="resource")


def by_session_timed(spark: SparkSession, sf_dir: str) -> EventLog:
    """The session log with an end half an hour after each start."""
    log = by_session(spark, sf_dir)
    return EventLog(log.df.withColumn("end_timestamp", F.col("timestamp") + F.expr("INTERVAL 30 MINUTES")))


def by_parity(spark: SparkSession, sf_dir: str) -> dict[str, EventLog]:
    """The session log as two: even and odd users."""
    log = by_session(spark, sf_dir)
    odd = F.split("case_id", "-")[0].cast("long") % 2 == 1
    return {"a": EventLog(log.df.where(~odd)), "b": EventLog(log.df.where(odd))}


def by_customer(spark: SparkSession, sf_dir: str) -> EventLog:
    """Orders with the customer as the case and the priority as the activity."""
    return EventLog.from_table(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", seq="o_orderkey")


def object_log(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """Order lines as events on orders, parts and suppliers; one event per order, date and flag."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate").isNotNull())
    eid = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag", "l_linestatus")
    activity = F.concat("l_returnflag", "l_linestatus")
    # Dealt by event before it is spelled out: distinct relations, and joins and counts by event, need no exchange of their own.
    lines = lines.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    columns = (eid.alias("eid"), activity.alias("activity"), F.col("l_shipdate").alias("timestamp"), "l_orderkey", "l_suppkey")
    base = lines.repartition(eid).select(*columns)
    objects = F.array(
        F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("oid"), F.lit("order").alias("type")),
        F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("oid"), F.lit("supplier").alias("type")),
    )
    related = lambda rows: rows.select("eid", "activity", "timestamp", F.explode(objects).alias("x")).select("eid", "x.oid", "x.type", "activity", "timestamp")
    relations = related(base).distinct().withColumn("qualifier", F.lit(None).cast("string"))
    repeated = related(lines.select(*columns)).withColumn("qualifier", F.lit(None).cast("string"))
    orders = table(spark, sf_dir, "orders")
    o2o = orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("oid"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("oid_2"),
        F.lit("placed by").alias("qualifier"),
    )
    customers = o2o.select(F.col("oid_2").alias("oid"), F.lit("customer").alias("type"))
    every = relations.select("oid", "type").union(o2o.select("oid", F.lit("order").alias("type"))).union(customers).distinct()
    return ObjectLog(base.select("eid", "activity", "timestamp").distinct(), every, relations, o2o, repeated)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return table(spark, sf_dir, "events").select("user_id", session.alias("session_id"), "event_type", F.col("ts").alias("occurred_at"))


EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts AS timestamp, event_id AS seq, value AS cost, props FROM events WHERE ts IS NOT NULL)"
SE = (
    "ev AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id, event_type AS activity, ts AS timestamp, "
    "event_id AS seq, value AS cost, 'r' || CAST(user_id % 7 AS VARCHAR) AS resource, ts + INTERVAL 30 MINUTE AS end_timestamp, user_id FROM events WHERE ts IS NOT NULL)"
)
CU = "ev AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, o_orderdate AS timestamp, o_orderkey AS seq FROM orders WHERE o_orderdate IS NOT NULL)"
SEC = "((epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE)"
TRACES = (
    "tr AS (SELECT case_id, string_agg(activity, '→' ORDER BY timestamp, seq) AS variant, min(timestamp) AS s, max(timestamp) AS e, count(*) AS n, "
    "(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS d, "
    "arg_min(activity, struct_pack(t := timestamp, q := seq)) AS fa, arg_max(activity, struct_pack(t := timestamp, q := seq)) AS la FROM ev GROUP BY case_id)"
)
EDGES = (
    "ed AS (SELECT * FROM (SELECT case_id, activity AS source, lead(activity) OVER w AS target, lead(seq) OVER w AS nseq, "
    "(epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp)) / 1000000.0::DOUBLE AS seconds FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY timestamp, seq)) WHERE nseq IS NOT NULL)"
)
OC = (
    "ln AS (SELECT CAST(l_orderkey AS VARCHAR) || '|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || l_returnflag || '|' || l_linestatus AS eid, "
    "l_returnflag || l_linestatus AS activity, l_shipdate AS timestamp, l_orderkey, l_suppkey FROM lineitem WHERE l_shipdate IS NOT NULL), "
    "rel AS (SELECT DISTINCT eid, 'o' || CAST(l_orderkey AS VARCHAR) AS oid, 'order' AS type, activity, timestamp FROM ln "
    "UNION SELECT DISTINCT eid, 's' || CAST(l_suppkey AS VARCHAR), 'supplier', activity, timestamp FROM ln), "
    "o2o AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS oid, 'c' || CAST(o_custkey AS VARCHAR) AS oid_2 FROM orders), "
    "obj AS (SELECT oid, type FROM rel UNION SELECT oid, 'order' FROM o2o UNION SELECT oid_2, 'customer' FROM o2o), "
    "evs AS (SELECT DISTINCT eid, activity, timestamp FROM ln)"
)
