"""Ranked lexical search: the best documents for each item, by WAND over document shards.

A document's score for an item is the sum over the item's terms (repeats included) of the
term's weight times a saturating share of its occurrences, all in integers (see `impact`).

1. One scan reduces every text to its length in terms and its occurrences of the items' terms,
   stored as postings by document. Counts of documents, of their terms and of the documents
   holding a term are aggregated over all rows of it.
2. Each task gathers its documents into shards of bounded size, orders a shard by doc_id, and
   turns it into lists of documents and impacts by term. For every item, WAND moves
   cursors over these lists: with cursors in order of document, the pivot is the first at which the
   terms' largest impacts add up to more than the heap's threshold; documents before it
   cannot enter the heap and are skipped by binary search. The threshold starts just below
   the largest k-th best single impact, which k documents reach.
3. The shards' heaps, k rows an item each, are merged by rank within the item; Spark applies the limit
   before its shuffle as well.

Within a shard documents come in order of doc_id, so one that only equals the threshold cannot
displace an earlier one, and skipping loses none.

Scale. Texts are read once per block of items and never shuffled; what is broadcast are the
terms of a block of items of at most `BLOCK_CHARS` characters, and more items make more blocks.
Postings are as large as the documents' distinct items' terms. No pair of document and item is formed.

Defined results: a null or empty text has no terms and is not counted; rows of documents that
repeat a doc_id are documents each; a null doc_id ranks after others of equal score; rows that
repeat an item_id (or have none) are one item with all their terms; an item without a document
of score above 0 has no rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import materialize, table, words_of

TOP = 10
BLOCK_CHARS = 4_000_000
SHARD_DOCS = 65_536
SHARD_POSTINGS = 2_000_000
B = 75


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - B + (B * n * n_docs) // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score before its weight, from occurrences and length factors."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms array<int>, tfs array<int>): length and occurrences of known terms of every document that has terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at, lengths, ends, terms, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                found = Counter(filter(known.__contains__, words))
                at.append(k)
                lengths.append(len(words))
                terms.extend(map(known.__getitem__, found))
                tfs.extend(found.values())
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """The documents of a shard in order of doc_id, and by term their places and impacts."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        ids = rows.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = np.array([length_factor(n, n_docs, n_terms) for n in rows.column("n").to_pylist()], np.int64)
        column = rows.column("terms").combine_chunks()
        term = column.flatten().to_numpy()
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), np.diff(column.offsets.to_numpy()))
        value = weights[term] * impact(tf, m[doc])
        doc = place[doc]
        by = np.lexsort((doc, term))
        by = by[value[by] > 0]
        self.term, self.doc, self.value = term[by], doc[by], value[by]
        names, starts = np.unique(self.term, return_index=True)
        self.range = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True), strict=True))
        self.lists: dict[int, tuple[list[int], list[int], int, int]] = {}

    def of(self, term: int, k: int) -> tuple[list[int], list[int], int, int] | None:
        """Documents, impacts, largest impact and k-th largest impact (0 if fewer) of a term."""
        if term not in self.lists:
            if term not in self.range:
                return None
            lo, hi = self.range[term]
            value = self.value[lo:hi]
            kth = int(np.partition(value, hi - lo - k)[hi - lo - k]) if hi - lo >= k else 0
            self.lists[term] = self.doc[lo:hi].tolist(), value.tolist(), int(value.max()), kth
        return self.lists[term]

    def top(self, item: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents for terms with their repeats; equal scores by place."""
        cursors, floor = [], 0
        for term, repeats in item:
            found = self.of(term, k)
            if found:
                docs, values, most, kth = found
                cursors.append([docs[0], 0, docs, values, most * repeats, repeats])
                floor = max(floor, kth * repeats - 1)
        heap: list[tuple[int, int]] = []
        while cursors:
            cursors.sort(key=_place)
            bound = 0
            for pivot in cursors:
                bound += pivot[4]
                if bound > floor:
                    break
            else:
                break
            doc = pivot[0]
            if cursors[0][0] == doc:
                score = 0
                for c in cursors:
                    if c[0] != doc:
                        break
                    score += c[3][c[1]] * c[5]
                    c[1] += 1
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
                if score > floor:
                    heapq.heappush(heap, (score, -doc))
                    if len(heap) > k:
                        heapq.heappop(heap)
                    if len(heap) == k:
                        floor = max(floor, heap[0][0])
            else:
                for c in cursors:
                    if c[0] >= doc:
                        break
                    c[1] = bisect_left(c[2], doc, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return [(score, -doc) for score, doc in sorted(heap, reverse=True)]


def _place(cursor: list) -> int:
    return cursor[0]


def _shards(batches: Iterator[pa.RecordBatch], docs: int, entries: int) -> Iterator[pa.Table]:
    """Batches gathered into tables of bounded size."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, min(docs, 1024)):
            part = batch.slice(at, min(docs, 1024))
            held.append(part)
            rows, size = rows + part.num_rows, size + len(part.column("terms").flatten())
            if rows >= docs or size >= entries:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _searched(docs: DataFrame, items: list[tuple[object, Counter]], item_type: T.DataType, top: int, shard_docs: int) -> DataFrame:
    """(item_id, score, doc_id): the shards' heaps for one block of items."""
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    rows = materialize(postings(docs, vocabulary), "wand-postings")
    whole = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weights[r["term"]] = weight(whole["docs"], r["df"])
    asked = [(item, [(vocabulary[w], n) for w, n in sorted(words.items())]) for item, words in items]
    shared = docs.sparkSession.sparkContext.broadcast((asked, weights, whole["docs"], whole["terms"]))
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("score", T.LongType()), T.StructField("doc_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, n_docs, n_terms = shared.value
        for part in _shards(batches, shard_docs, SHARD_POSTINGS):
            shard = Shard(part, weights, n_docs, n_terms)
            out: list[list] = [[], [], []]
            for item, terms in asked:
                for score, place in shard.top(terms, top):
                    for held, x in zip(out, (item, score, shard.ids[place]), strict=True):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], _arrow(item_type)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["item_id", "score", "doc_id"])

    return rows.where(F.size("terms") > 0).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(kind, T.StringType) else pa.int64()


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms, in blocks of bounded size; rows of one item stay together."""
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()["chars"]
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        words: dict[object, Counter] = {}
        for row in part.collect():
            words.setdefault(row["item_id"], Counter()).update(words_of(row["text"]))
        yield [(item, found) for item, found in words.items() if found]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents (doc_id, text) of each of items (item_id, text)."""
    kind = items.schema["item_id"].dataType
    kind = kind if isinstance(kind, T.StringType) else T.LongType()
    heaps = None
    for block in _blocks(items.select(F.col("item_id").cast(kind).alias("item_id"), "text"), block_chars):
        part = _searched(docs, block, kind, top, shard_docs)
        heaps = part if heaps is None else heaps.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (
    r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
)
ORACLE = f"""WITH q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS t FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)) GROUP BY ALL),
l AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY r), w AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
m AS (SELECT r, 100 - 75 + (75 * n * nn) // ll AS m FROM l, w),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM d GROUP BY t), w),
s AS (SELECT q.item_id, d.r, d.doc_id, CAST(sum(q.q * f.w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m.m))) AS BIGINT) AS score FROM q JOIN d USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
