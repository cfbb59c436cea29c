"""Versions, edits, stored results, replayed batches and session state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseweave import streaming
from caseweave.operators import access, discovery
from caseweave.sources import readers, store
from tests.helpers import rows, three_cases


def table(log):
    return {tuple(r) for r in log.df.select("case_id", "activity", "timestamp").collect()}


def test_edits_make_versions_and_readers_keep_theirs(spark, tmp_path):
    root, log = str(tmp_path / "store"), three_cases(spark)
    assert store.write(log, root, "import") == 1
    held = store.read(spark, root)
    before = table(held)
    order = [r["case_id"] for r in access.indexed(held).orderBy("row_index").collect()]
    edits = spark.createDataFrame([(0, 0, "activity", "first"), (1, 0, "activity", "second"), (2, 1, "case_id", "case-9"), (3, 2, "timestamp", "2031-01-01 00:00:00")], "position int, row_index long, field string, value string")
    assert store.edit(spark, root, edits, "by hand", version=1) == 2
    assert table(held) == before and table(store.read(spark, root, 1)) == before
    new = access.indexed(store.read(spark, root)).orderBy("row_index").collect()
    assert len(new) == len(before) and [r["case_id"] for r in new] == sorted(r["case_id"] for r in new)
    assert sum(r["activity"] == "second" for r in new) == 1 and not any(r["activity"] == "first" for r in new)
    assert new[-1]["case_id"] == "case-9"
    audit = store.audit(spark, root).collect()
    assert {(r["row_index"], r["field"], r["new_value"]) for r in audit} == {(0, "activity", "second"), (1, "case_id", "case-9"), (2, "timestamp", "2031-01-01 00:00:00")}
    assert next(r for r in audit if r["field"] == "case_id")["new_row_index"] == len(new) - 1
    assert next(r for r in audit if r["field"] == "case_id")["old_value"] == order[1]
    assert rows(store.versions(spark, root).select("version", "parent", "note", "events")) == {(1, 0, "import", 9), (2, 1, "by hand", 9)}


@pytest.mark.parametrize(
    ("row", "field", "value", "error"),
    [(99, "activity", "x", IndexError), (-1, "activity", "x", IndexError), (0, "colour", "x", ValueError), (0, "timestamp", "no time", ValueError), (0, "timestamp", None, ValueError), (0, "activity", None, ValueError)],
)
def test_bad_edits_make_no_version(spark, tmp_path, row, field, value, error):
    root = str(tmp_path / "store")
    store.write(three_cases(spark), root)
    with pytest.raises(error):
        store.edit(spark, root, spark.createDataFrame([(0, row, field, value)], "position int, row_index long, field string, value string"))
    assert store.versions(spark, root).count() == 1


def test_writers_from_one_version_conflict(spark, tmp_path):
    root, log = str(tmp_path / "store"), three_cases(spark)
    store.write(log, root)
    store.write(log, root)
    with pytest.raises(store.Conflict):
        store._commit(spark, root, log.df, 1, "", None)
    with pytest.raises(store.Conflict):
        store.edit(spark, root, spark.createDataFrame([(0, 0, "activity", "x")], "position int, row_index long, field string, value string"), version=1)
    assert store.latest(spark, root)["version"] == 2
    with pytest.raises(ValueError, match="no such version"):
        store.read(spark, str(tmp_path / "nothing"))


def test_results_are_stored_until_the_log_changes(spark, tmp_path):
    root, calls = str(tmp_path / "store"), []
    store.write(three_cases(spark), root)

    def variants(log, least=0):
        calls.append(least)
        return access.variants(log).where(F.col("n_cases") >= least)

    first = rows(store.result(spark, root, variants))
    assert rows(store.result(spark, root, variants)) == first and calls == [0]
    assert store.result(spark, root, variants, least=2).count() < len(first) and calls == [0, 2]
    seen = store.result(spark, root, variants, view=F.col("activity") != "cancel")
    assert store.result(spark, root, variants, view=F.col("activity") != "cancel").count() == seen.count() and len(calls) == 3
    assert store.result(spark, root, discovery.edge_total).count() == 1
    store.edit(spark, root, spark.createDataFrame([(0, 0, "activity", "new")], "position int, row_index long, field string, value string"))
    assert rows(store.result(spark, root, variants)) != first and len(calls) == 4
    held = {(r["version"], r["current"]): r["results"] for r in store.stored_results(spark, root).collect() if "variants" in r["operator"]}
    assert held == {(1, False): 3, (2, True): 1}


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    target, batches = str(tmp_path / "out"), []

    class Sink:
        """Hands the batch function of `follow` over, as a stream would call it."""

        def foreachBatch(self, f):  # noqa: N802
            batches.append(f)
            return self

        option = trigger = outputMode = lambda self, *a, **k: self

        def start(self):
            return self

    class Stream:
        writeStream = Sink()  # noqa: N815

    df = spark.createDataFrame([("c", "a", 1)], "case_id string, activity string, seq long")
    for checkpoint in ("one", "two"):
        streaming.follow(Stream(), target, checkpoint)
        for k in (0, 0, 1):
            batches[-1](df, k)
    assert spark.read.parquet(target).count() == 4


def deliver(folder, name, lines):
    (folder / f"{name}.csv").write_text("delivery,session_id,user_id,started_at,occurred_at\n" + "".join(f"{x}\n" for x in lines))


def test_sessions_take_each_delivery_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    at = lambda h: f"2026-01-01 {h}:00"
    first = [f"d1,s1,u1,{at('10:00')},{at('10:00')}", f"d1,s1,u1,{at('10:00')},{at('10:05')}", f"d2,s2,u2,{at('10:01')},{at('10:01')}"]

    def run():
        stream = streaming.sessions(streaming.watch(spark, str(folder), schema=streaming.USAGE_SCHEMA), "30 minutes", "1 hour")
        streaming.follow(stream, target, str(tmp_path / "ck"), mode="update").awaitTermination(90)
        return {r["session_id"]: (r["user_id"], r["events"], r["last_seen"].strftime("%H:%M"), r["closed"]) for r in streaming.current_sessions(spark, target).collect()}

    deliver(folder, "a", first)
    assert run() == {"s1": ("u1", 2, "10:05", False), "s2": ("u2", 1, "10:01", False)}
    deliver(folder, "b", [*first, f"d3,s1,u1,{at('10:00')},{at('10:20')}", f"d4,s1,u9,{at('10:00')},{at('10:21')}"])
    assert run() == {"s1": ("u1", 3, "10:20", False), "s2": ("u2", 1, "10:01", False)}
    deliver(folder, "c", [f"d5,s3,u3,{at('15:00')},{at('15:00')}"])
    run()
    deliver(folder, "d", [f"d6,s3,u3,{at('15:00')},{at('15:01')}"])
    done = run()
    assert done["s1"] == ("u1", 3, "10:20", True) and done["s2"][3] and done["s3"][:2] == ("u3", 2)


def test_constraint_lines_keep_their_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "constraints.csv"
    path.write_text("response(a);;precedence(b);\nConfidence;Support;Confidence;Support\n" + "".join(f"{k};0;{k * 2};1\n" for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = rows(readers.read_constraints(spark, str(path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {("response(a)", k, float(k)) for k in range(400)} | {("precedence(b)", k, float(2 * k)) for k in range(400)}
