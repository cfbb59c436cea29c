"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
lower-cased. A window is n consecutive words of a benchmark item; an item with
fewer words, but not none, is one window. Documents are scanned once, without a
shuffle: words become ids of the benchmark's own vocabulary, stretches that are
wholly inside that vocabulary are looked up in the hash set of windows, and each
hit's ids are compared with the item's, so a hit is exact. The set is three sorted
arrays (hash, place, item) over the items' ids, some 20 bytes a benchmark word.

The broadcast is bounded: a benchmark above `block_chars` characters is dealt
into blocks. Rows are then stored once with a number of their own, each block is
broadcast by itself against the stored texts, and the hits are merged by row before
anything is cut or dropped, so the result does not depend on the number of blocks.

Defined results: a null or empty text has no words and no hits; null ids pass
through; repeated rows are reported each; an empty benchmark hits nothing;
further columns of either table are ignored by `scan` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import WORD_BYTES, materialize, slices, table, words_of

N = 10
BLOCK_CHARS = 8_000_000


class Windows:
    """The windows of a block of items: vocabulary, ids of all words, and for each length the sorted hashes with places and items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        self.places = np.random.default_rng(n).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        parts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.words = np.concatenate([*parts, np.zeros(0, np.int32)])
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        offset = 0
        for k, ids in enumerate(parts):
            size = min(n, len(ids))
            if size:
                at = np.arange(len(ids) - size + 1)
                hashes = self._hash(ids, at, size)
                if len(np.unique(hashes)) < len(hashes):
                    at = np.unique(np.lib.stride_tricks.sliding_window_view(ids, size), axis=0, return_index=True)[1]
                    hashes = hashes[at]
                found.setdefault(size, []).append((hashes, offset + at, np.full(len(at), k, np.int32)))
            offset += len(ids)
        self.by_length = {}
        for size, rows in found.items():
            hashes, at, item = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = hashes[order], at[order], item[order]

    def _hash(self, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(size):
            out += ids[at + j].astype(np.uint64) * self.places[j]
        return out ^ (out >> np.uint64(31))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of the words that lie in an occurrence of a window, and the items hit."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        hit = np.zeros(len(ids) + 1, dtype=np.int64)
        items: set[str] = set()
        for size, (hashes, at, item) in self.by_length.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            sought = self._hash(ids, starts, size)
            lo, hi = np.searchsorted(hashes, sought), np.searchsorted(hashes, sought, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                start = int(starts[k])
                own = ids[start : start + size]
                same = [e for e in range(lo[k], hi[k]) if (self.words[at[e] : at[e] + size] == own).all()]
                if same:
                    hit[start] += 1
                    hit[start + size] -= 1
                    items.update(self.items[item[e]] for e in same)
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), items


def _blocks(benchmark: DataFrame, n: int, block_chars: int) -> tuple[int, Iterator[Windows]]:
    """The number of blocks of bounded size, and the benchmark's windows by block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    blocks = -(-chars // block_chars) or 1

    def windows() -> Iterator[Windows]:
        for k in range(blocks):
            part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
            yield Windows([(r["item"], r["text"]) for r in part.collect()], n)

    return blocks, windows()


def _scan(docs: DataFrame, names: list[str], windows: Windows) -> tuple[DataFrame, Broadcast]:
    """The named columns of docs with n_words, hits and items of one block, and its broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = T.StructType(
        [
            *(T.StructField(c, docs.schema[c].dataType) for c in names),
            T.StructField("n_words", T.LongType()),
            T.StructField("hits", T.ArrayType(T.IntegerType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            n_words, hits, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                at, found = windows.scan(words)
                n_words.append(len(words))
                hits.append(at.tolist())
                items.append(sorted(x for x in found if x is not None))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=schema.names,
            )

    return docs.select(*names, "text").mapInArrow(run, schema), shared


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with cw_row, a number of each row, stored so that all blocks see the same one."""
    return materialize(docs.withColumn("cw_row", F.monotonically_increasing_id()), "decontaminate-rows")


def _merged(rows: DataFrame, blocks: Iterator[Windows]) -> DataFrame:
    """(cw_row, n_words, hits, items) of each of the numbered rows over all blocks."""
    every = None
    for windows in blocks:
        part, shared = _scan(rows, ["cw_row"], windows)
        part = materialize(part, "decontaminate-hits")
        shared.unpersist()
        every = part if every is None else every.unionByName(part)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return every.groupBy("cw_row").agg(F.max("n_words").alias("n_words"), union("hits"), union("items"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, hits array<int>, items array<string>): word positions hit and the items found, sorted."""
    blocks, windows = _blocks(benchmark, n, block_chars)
    if blocks == 1:
        return _scan(docs, ["doc_id"], next(windows))[0]
    rows = _numbered(docs.select("doc_id", "text"))
    return rows.join(_merged(rows, windows), "cw_row").select("doc_id", "n_words", "hits", "items")


def _cut(text: str, hit: set[int]) -> str:
    """text without the words at these positions and what stands between neighbouring ones."""
    out, last, inside = [], 0, False
    data = text.encode("utf-8", "surrogatepass")
    plain = data.translate(WORD_BYTES)
    at = 0
    for k, word in enumerate(plain.split()):
        start = plain.index(word, at)
        at = start + len(word)
        if k in hit:
            if not inside:
                out.append(data[last:start])
            inside, last = True, at
        else:
            inside = False
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean(
    docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = 0.5, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs, same columns: spans that repeat a benchmark window are cut out of text.

    A document of which `drop_share` of its words or more are hit goes as a whole.
    n_chars, where there is such a column, follows the new text.
    """
    names = docs.columns
    blocks, windows = _blocks(benchmark, n, block_chars)
    if blocks == 1:
        rows, shared = docs, docs.sparkSession.sparkContext.broadcast(next(windows))
    else:
        rows, shared = _numbered(docs), None
        hits = _merged(rows, windows).select("cw_row", F.col("hits").alias("cw_hits"))
        rows = rows.join(hits, "cw_row").drop("cw_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keep, changed = batch.column("text").to_pylist(), [], False
            found = None if shared else batch.column("cw_hits").to_pylist()
            batch = batch.select(names)
            for k, text in enumerate(texts):
                words = words_of(text)
                at = shared.value.scan(words)[0].tolist() if shared else found[k]
                keep.append(not len(at) or len(at) < drop_share * len(words))
                if len(at) and keep[-1]:
                    texts[k], changed = _cut(text, set(at)), True
            if changed:
                where = batch.schema.get_field_index("text")
                batch = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))
                if "n_chars" in names:
                    where = batch.schema.get_field_index("n_chars")
                    kind = batch.schema.field(where)
                    sizes = [None if t is None else len(t) for t in texts]
                    batch = batch.set_column(where, kind, pa.array(sizes, pa.int64()).cast(kind.type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op8 contract from scan()'s rows."""
    items: Column = F.array_sort("items")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, k, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
