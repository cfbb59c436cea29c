from __future__ import annotations

from caseweave import streaming
from caseweave.operators import access
from tests.helpers import ROWS, rows, three_cases


def test_follow_appends_new_files_once(spark, tmp_path):
    folder, target = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    text = "case_id,activity,timestamp,seq\n" + "".join(f"{c},{a},{t}:00,{k}\n" for k, (c, a, t, _) in enumerate(ROWS))
    (folder / "a.csv").write_text(text)

    def run():
        stream = streaming.once(streaming.watch(spark, str(folder)))
        streaming.follow(stream, str(target), str(tmp_path / "ck")).awaitTermination(60)
        return spark.read.parquet(str(target))

    assert run().count() == 9
    (folder / "b.csv").write_text("case_id,activity,timestamp,seq\ncase-1,ship,2026-01-01 11:30:00,2\ncase-4,ship,2026-01-03 11:30:00,9\n")
    again = run()
    assert again.count() == 10
    assert streaming.touched_cases(again, again.where("case_id = 'case-4'")).count() == 1


def test_edit_with_audit(spark):
    log = three_cases(spark)
    indexed = access.indexed(log)
    edits = spark.createDataFrame([(5, "ship")], "row_index long, value string")
    new, audit = streaming.edit(indexed, edits, "activity")
    assert rows(audit) == {(5, "activity", "cancel", "ship")}
    assert access.variants(streaming.edited_log(new)).count() == 1


def test_changed_files(spark):
    seen = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "path string, size int, modified int")
    now = spark.createDataFrame([("a", 1, 10), ("b", 3, 20), ("c", 1, 5)], "path string, size int, modified int")
    assert rows(streaming.changed_files(now, seen), "path") == {("b",), ("c",)}
