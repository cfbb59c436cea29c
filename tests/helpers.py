from __future__ import annotations

from datetime import datetime, timedelta

from caseweave.log import EventLog, ObjectLog

ROWS = [
    ("case-1", "register order", "2026-01-01 08:00", "alice"),
    ("case-1", "check stock", "2026-01-01 09:00", "bob"),
    ("case-1", "ship", "2026-01-01 11:30", "alice"),
    ("case-2", "register order", "2026-01-01 08:30", "alice"),
    ("case-2", "check stock", "2026-01-01 10:15", "bob"),
    ("case-2", "cancel", "2026-01-01 10:45", "bob"),
    ("case-3", "register order", "2026-01-02 09:00", "carol"),
    ("case-3", "check stock", "2026-01-02 09:45", "bob"),
    ("case-3", "ship", "2026-01-02 12:00", "alice"),
]
SCHEMA = "case_id string, activity string, timestamp timestamp_ntz, resource string, seq long"


def three_cases(spark) -> EventLog:
    rows = [(c, a, datetime.strptime(t, "%Y-%m-%d %H:%M"), r, k) for k, (c, a, t, r) in enumerate(ROWS)]
    return EventLog(spark.createDataFrame(rows, SCHEMA))


def of_variants(spark, spec: dict[str, int]) -> EventLog:
    """Case k starts k days after 2023-01-01; events are an hour apart."""
    rows, case = [], 0
    for trace, n in spec.items():
        for _ in range(n):
            start = datetime(2023, 1, 1) + timedelta(days=case)
            rows += [(f"c{case:03d}", a, start + timedelta(hours=k), "r", len(rows) + k) for k, a in enumerate(trace.split(","))]
            case += 1
    return EventLog(spark.createDataFrame(rows, SCHEMA))


OBJECT_ROWS = [
    ("e1", "create order", 1, "o1", "order"),
    ("e2", "add item", 2, "o1", "order"),
    ("e2", "add item", 2, "i1", "item"),
    ("e3", "add item", 3, "o1", "order"),
    ("e3", "add item", 3, "i2", "item"),
    ("e4", "pay", 4, "o1", "order"),
    ("e5", "ship", 5, "i1", "item"),
    ("e5", "ship", 5, "i2", "item"),
]


def orders_and_items(spark) -> ObjectLog:
    rows = [(e, o, t, a, datetime(2024, 1, d), None) for e, a, d, o, t in OBJECT_ROWS]
    relations = spark.createDataFrame(rows, "eid string, oid string, type string, activity string, timestamp timestamp_ntz, qualifier string")
    return ObjectLog(
        relations.select("eid", "activity", "timestamp").distinct(),
        relations.select("oid", "type").distinct(),
        relations,
        spark.createDataFrame([], "oid string, oid_2 string, qualifier string"),
    )


def rows(df, *columns) -> set:
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}
