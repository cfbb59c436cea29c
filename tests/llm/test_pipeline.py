"""The stages in order, on a small corpus with known outcomes."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseweave.llm import common, minhash
from caseweave.llm.common import materialize
from tests.llm.test_models_and_dedup import DOCS, components, prose, unique


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, prose(rng, 60, "de" if k % 2 else "en", [f"q{k}x{j}" for j in range(30)]), "de" if k % 2 else "en", f"s{k % 3}", 1) for k in range(80)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows += [(100, rows[0][1], "en", "s0", 1), (101, item, "en", "s1", 1), (102, "12 34 !!", None, "s1", 1), (103, None, "en", "s2", 0)]
    rows[4] = (4, rows[4][1] + " mail a@b.example.com now", *rows[4][2:])
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = materialize(out, "stage")
        sizes.append(docs.count())
    assert sizes == [82, 81, 80, 80]
    mixed = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {100, 101, 102, 103} & set(mixed)
    assert all("@" not in r["text"] and 1 <= r["copies"] <= 3 for r in mixed.values())


def test_mix_counts_rows_of_one_id_apart(spark, tmp_path):
    """Repeated rows, rows without id or source, and columns that clash: the mix keeps its targets and the columns."""
    rng = random.Random(12)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, prose(rng, 20), "en", None if k % 2 else "s", 1, 9, "x") for k in range(120)]
    rows += rows[:10] + [(500, None, None, "s", None, 9, "x"), (501, "", None, "s", 0, 9, "x")]
    given = spark.createDataFrame(rows, DOCS + ", copies long, cw_row string")
    given.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()
    assert set(out[0].asDict()) == set(docs.columns) and all(r["cw_row"] == "x" for r in out)
    words = sum(20 for r in rows if r[1])
    taken = Counter()
    for r in out:
        assert 1 <= r["copies"] <= 3 and r["doc_id"] not in (500, 501)
        taken[r["source"]] += 20 * r["copies"]
    assert abs(taken["s"] - words / 3) <= 20 and abs(taken[None] - 2 * words / 3) <= 20
    assert corpus_pipeline.mixture(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_columns_and_nulls(spark, tmp_path):
    rows = [(1, "the and that with from have this will", "en", None, 1, 2), (None, "the and that with from have this", "en", "s", None, 3), (None, None, None, None, None, None), (2, "", "en", "s", 0, 5)]
    docs = spark.createDataFrame(rows, DOCS + ", hits long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns[-1] == "hits"
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert sorted(r["hits"] for r in docs.collect()) == [2, 3]


def test_near_duplicates_of_a_large_group_all_go(spark, tmp_path, monkeypatch):
    """Unlike documents that share one sketch, among them near copies that share no other: the stage keeps one of each class."""
    rng = random.Random(78)
    base = [unique(rng, 50).split() for _ in range(24)]
    texts = base + [[*words[:20], f"y{k}", *words[21:]] for k, words in enumerate(base[10:])]
    docs = spark.createDataFrame([(k, " ".join(words), "en", "s", 1) for k, words in enumerate(texts)], DOCS)
    own = minhash.signatures

    def one_shared(docs):
        return own(docs).withColumn("bands", F.concat(F.array(F.lit(7)), F.transform(F.sequence(F.lit(1), F.lit(31)), lambda j: F.xxhash64("key", j))))

    monkeypatch.setattr(minhash, "signatures", one_shared)
    words = {k: common.words_of(" ".join(t)) for k, t in enumerate(texts)}
    edges = [(a, b) for a in words for b in words if a < b and minhash.edit_distance_within(words[a], words[b], 10) is not None]
    want = components(edges, list(words))
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert left == sorted(set(want.values())) == list(range(24))


def test_near_duplicates_make_no_row_for_a_pair(spark, tmp_path, monkeypatch):
    """Documents that share a passage and one sketch, just unlike enough to stay, and near copies of some: the stage's candidates grow with documents."""
    rng = random.Random(81)
    passage = unique(rng, 300).split()
    pool = [f"y{k}" for k in range(2_000)]  # so that the rarest words are shared as well
    base = [passage + rng.sample(pool, 100) for _ in range(50)]
    texts = base + [[*words[:20], f"z{k}", *words[21:]] for k, words in enumerate(base[30:])]
    docs = spark.createDataFrame([(k, " ".join(words), "en", "s", 1) for k, words in enumerate(texts)], DOCS)
    signatures, alike, rows = minhash.signatures, minhash._alike, []

    def one_shared(docs):
        return signatures(docs).withColumn("bands", F.concat(F.array(F.lit(7)), F.transform(F.sequence(F.lit(1), F.lit(31)), lambda j: F.xxhash64("key", j))))

    def counted(*given):
        out = common.materialize(alike(*given), "test-alike")
        rows.append(out.count())
        return out

    monkeypatch.setattr(minhash, "signatures", one_shared)
    monkeypatch.setattr(minhash, "_alike", counted)
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert left == list(range(50)) and len(rows) == 1 and 0 < rows[0] <= len(texts)


def test_slices_hold_all_rows_in_order():
    texts = ["x" * (k % 7 * 3_000) for k in range(1_500)] + ["y" * 5_000_000, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    parts = list(common.slices(iter([batch.slice(0, 0), batch, batch.slice(3, 2)])))
    assert [x for part in parts for x in part.column("text").to_pylist()] == texts + texts[3:5]
    assert all(0 < part.num_rows <= common.SLICE_ROWS for part in parts)
    assert max(sum(len(x or "") for x in part.column("text").to_pylist()) for part in parts) <= 5_000_000 + 2 * common.SLICE_BYTES


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontaminate"])
def test_tasks_hold_few_texts_at_once(spark, tmp_path, monkeypatch, name):
    """A partition of some 13 MB of texts: no Python task of the stage holds that much, and no document is lost."""
    rng = random.Random(83)
    rows = [(k, prose(rng, 1_000, "en", [f"w{k}x{j}" for j in range(400)]), "en", "s", 1) for k in range(2_000)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    frame = type(docs)
    own = frame.mapInArrow

    def watched(self, run, schema, *more):
        def checked(batches):
            import tracemalloc

            pa.array(["x"])  # imports what Arrow needs
            tracemalloc.start()
            try:
                for out in run(batches):
                    peak = tracemalloc.get_traced_memory()[1]
                    assert peak < 20_000_000, f"held {peak} bytes"
                    yield out
            finally:
                tracemalloc.stop()

        return own(self, checked, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).count() == len(rows)
