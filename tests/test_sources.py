from __future__ import annotations

import json

import pytest

from caseweave.log import EventLog
from caseweave.operators import access
from caseweave.sources import readers, roles, writers
from tests.helpers import ROWS, orders_and_items, rows, three_cases


def _same(log: EventLog) -> None:
    assert log.events.count() == 9
    assert rows(access.variants(log), "variant", "n_cases") == {("register order→check stock→ship", 2), ("register order→check stock→cancel", 1)}
    assert access.kpi_summary(log).first()["avg_cycle_time_s"] == 10500.0


def test_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("Case ID,Activity,Timestamp,resource\n" + "".join(f"{c},{a},{t.replace(' ', 'T')}:00+00:00,{r}\n" for c, a, t, r in ROWS) + "case-4,lost,not a time,\n")
    _same(readers.read_log(spark, str(path)))


def test_json_and_xml(spark, tmp_path):
    events = [{"case_id": c, "activity": a, "timestamp": f"{t}:00", "nested": {"x": 1}} for c, a, t, _ in ROWS]
    (tmp_path / "log.json").write_text(json.dumps({"meta": 1, "events": events}))
    _same(readers.read_log(spark, str(tmp_path / "log.json")))
    body = "".join(f'<event case_id="{c}"><activity>{a}</activity><timestamp>{t}:00</timestamp></event>' for c, a, t, _ in ROWS)
    (tmp_path / "log.xml").write_text(f"<export>{body}</export>")
    _same(readers.read_log(spark, str(tmp_path / "log.xml")))


def test_xes_round_trip(spark, tmp_path):
    writers.write_xes(three_cases(spark), str(tmp_path / "out.xes"))
    log = readers.to_log(readers.read_xes(spark, str(tmp_path / "out.xes")))
    _same(log)


def test_xes_types(spark, tmp_path):
    """Tags decide types; a key with a bad value, of two tags, with markup, and nulls."""
    attribute = '<{} key="{}" value="{}"/>'.format
    events = [
        [("string", "concept:name", "a"), ("date", "time:timestamp", "2026-01-01T08:00:00.5+02:00"), ("int", "n", "3"), ("boolean", "ok", "true"), ("date", "due", "2026-02-01T00:00:00Z"), ("int", "mixed", "1"), ("int", "loose", "1"), ("float", "x", "1.5")],
        [("string", "concept:name", "b"), ("date", "time:timestamp", "2026-01-01T09:00:00"), ("int", "n", "many"), ("string", "mixed", "&lt;two&gt;"), ("float", "loose", "2.5"), ("int", "org:resource", "7")],
    ]
    body = "".join(f"<event>{''.join(attribute(*a) for a in e)}</event>" for e in events)
    (tmp_path / "in.xes").write_text(f'<log><trace>{attribute("string", "concept:name", "c1")}{attribute("int", "size", "12")}{body}</trace></log>')
    df = readers.read_xes(spark, str(tmp_path / "in.xes"))
    assert {"n": "bigint", "ok": "boolean", "due": "timestamp_ntz", "mixed": "string", "loose": "double", "x": "double", "case:size": "bigint", "resource": "string", "timestamp": "string"}.items() <= dict(df.dtypes).items()
    assert rows(df, "activity", "n", "mixed", "loose", "case:size", "ok") == {("a", 3, "1", 1.0, 12, True), ("b", None, "<two>", 2.5, 12, None)}
    writers.write_xes(readers.to_log(df), str(tmp_path / "out.xes"))
    again = readers.read_xes(spark, str(tmp_path / "out.xes"))
    assert rows(again, "activity", "n", "mixed", "loose", "case:size", "due") == rows(df, "activity", "n", "mixed", "loose", "case:size", "due")
    assert dict(again.dtypes)["ok"] == "boolean"


def test_parquet_round_trip(spark, tmp_path):
    meta = writers.write_log(three_cases(spark), str(tmp_path / "log"))
    assert meta["events"] == 9 and meta["cases"] == 3
    _same(readers.read_log(spark, str(tmp_path / "log/events.parquet")))


def test_ocel(spark, tmp_path):
    doc = {
        "ocel:events": {"e1": {"ocel:activity": "create order", "ocel:timestamp": "2026-01-01T08:00:00", "ocel:omap": ["o1", "c1"]}, "e2": {"ocel:activity": "pay", "ocel:timestamp": "2026-01-01T09:00:00", "ocel:omap": ["o1"]}},
        "ocel:objects": {"o1": {"ocel:type": "order"}, "c1": {"ocel:type": "customer"}},
    }
    (tmp_path / "log.jsonocel").write_text(json.dumps(doc))
    log = readers.read_ocel_json(spark, str(tmp_path / "log.jsonocel"))
    assert rows(log.relations, "eid", "oid", "type") == {("e1", "o1", "order"), ("e1", "c1", "customer"), ("e2", "o1", "order")}
    writers.write_object_log(orders_and_items(spark), str(tmp_path / "tables"))
    assert readers.read_object_tables(spark, str(tmp_path / "tables")).relations.count() == 8


def test_roles(spark):
    def resolve(columns, sample=None, overrides=None):
        return roles.resolve(spark.createDataFrame([tuple(sample or ["x"] * len(columns))], columns), overrides)

    assert not resolve(["case_id", "activity", "timestamp", "resource"]).needs_review
    assert not resolve(["Case ID", "Activity", "Timestamp"]).needs_review
    fuzzy = resolve(["case_id", "Action Type", "timestamp"])
    assert fuzzy.columns["activity"] == "Action Type" and fuzzy.needs_review
    typed = resolve(["case_id", "activity", "when_it_happened"], ["1", "a", "2026-01-01 08:00:00"])
    assert typed.columns["timestamp"] == "when_it_happened" and typed.needs_review
    with pytest.raises(roles.UnresolvedRole):
        resolve(["case_id"])
    assert roles.dedupe_case_insensitive(["Permit id", "permit id"]) == {"Permit id": "Permit id", "permit id": "permit id__src"}


def test_constraints(spark, tmp_path):
    (tmp_path / "c.csv").write_text("A;A;B\nSupport;Confidence;Confidence\n1;0.5;0.25\n1;0.75;1\n")
    assert rows(readers.read_constraints(spark, str(tmp_path / "c.csv"))) == {("A", 0, 0.5), ("B", 0, 0.25), ("A", 1, 0.75), ("B", 1, 1.0)}


def test_formats():
    assert [readers.detect_format(x) for x in ("a.csv", "a.XES.gz", "b.jsonocel", "c.parquet")] == ["csv", "xes", "ocel-json", "parquet"]


def test_xes_of_many_parts_is_read_whole(spark, tmp_path):
    """A document in several parts of many traces, each read in splits; the reader took one trace of every part but the first."""
    body = spark.range(4000).selectExpr("concat('c', id % 800) AS case_id", "concat('a', id % 3) AS activity", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS timestamp", "id AS seq")
    out = str(tmp_path / "out.xes")
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        writers.write_xes(EventLog(body), out)
        parts = len(list((tmp_path / "out.xes").glob("part-*")))
        back = rows(readers.read_log(spark, out).events, "case_id", "activity", "timestamp")
    finally:
        for key, value in (("spark.sql.shuffle.partitions", 2), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.files.maxPartitionBytes", "128m")):
            spark.conf.set(key, value)
    assert parts > 2 and back == rows(body, "case_id", "activity", "timestamp")


@pytest.mark.parametrize("inside", ["", "<!-- <trace><event/> -->", "<!-- <trace><event/></trace> <trace></trace> -->", "<![CDATA[<trace>]]>"])
def test_xes_traces_beside_other_markup(spark, tmp_path, inside):
    """Empty traces, space in tags, comments and character data that hold or close traces."""
    trace = '<trace>{0}<string key="concept:name" value="c{1}"/><event><string key="concept:name" value="a &gt; b"/><date key="time:timestamp" value="2026-01-0{1}T08:00:00"/></event></trace >'
    (tmp_path / "in.xes").write_text(f'<?xml version="1.0"?>\n<!-- one --><log xes.version="1.0"><global scope="trace"><string key="concept:name" value="x"/></global>{inside}<trace/><trace />{trace.format(inside, 1)}\n{inside}{trace.format("", 2)}</log>')
    assert rows(readers.read_xes(spark, str(tmp_path / "in.xes")), "case_id", "activity") == {("c1", "a > b"), ("c2", "a > b")}


def test_xes_types_and_trace_attributes_of_many_parts(spark, tmp_path):
    """Types and attributes of traces come from all parts, not from the first."""
    body = spark.range(2000).selectExpr("concat('c', lpad(id % 400, 3, '0')) AS case_id", "'a' AS activity", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS timestamp", "id AS seq", "CASE WHEN id % 400 > 200 THEN id END AS number", "id % 400 % 3 AS `case:group`")
    out = str(tmp_path / "out.xes")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 6)
    try:
        writers.write_xes(EventLog(body), out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    back = readers.read_log(spark, out).events
    assert {"number": "bigint", "case:group": "bigint"}.items() <= dict(back.dtypes).items()
    assert rows(back, "case_id", "timestamp", "number", "case:group") == rows(body, "case_id", "timestamp", "number", "case:group")
