"""Line dedup through a sharded minimal perfect hash.

A text's lines are compared by key: stripped of white space at both ends, A-Z lower-cased.
A key of at least `LEAST_CHARS` code points found in at least `LEAST_DOCS` documents loses all
its lines but those of the document that keeps it, the one of largest doc_id.

1. One scan turns every document into the distinct 128-bit hashes of its long keys; one
   aggregation, combined before its shuffle, counts documents by hash and finds the keeper.
2. Hashes are dealt into shards of about `SHARD_KEYS`, by their number. A task lays a shard's
   hashes out with a minimal perfect hash: levels of bit arrays in which a hash without a
   collision takes its place and the others go on to the next level; the number of bits
   set before a place is the hash's index. Compact arrays by index hold a fingerprint (the 64 bits
   that did not choose the shard), the count and the keeper. Only hashes of
   enough documents get an entry: no other line is ever dropped, and the fingerprint turns it away.
3. Documents probe the arrays. Where all shards together are at most `BROADCAST_BYTES` (measured
   before), they are broadcast, and one scan of the texts cuts the lines: neither texts nor
   lines are shuffled. Else the documents' hashes, without their texts, are dealt to
   the shards, those of a busy shard over several copies of it, are probed in a stream behind
   their shard's arrays, and the hashes to drop meet the texts by row number.
   Both ways give the same result.

Hashes are not compared with the lines; two of 10**12 different lines agree in 128 bits with a
probability below 10**-14.

Defined results: a null or empty text is one empty line; \\r and other white space stay in the
lines kept; rows that repeat a doc_id are documents each, and all rows of the keeper's
doc_id keep the line; rows without a doc_id count, and keep a line only if no row
that holds it has one; an empty table gives an empty result; `clean` keeps all columns, whatever
their names, and n_chars follows where lines were dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import free_name, materialize, table

LEAST_CHARS = 40
LEAST_DOCS = 5
SHARD_KEYS = 100_000
BROADCAST_BYTES = 64_000_000
#: Hashes that one copy of a shard is probed with, where shards are not broadcast.
PROBES = 2_000_000
ADDED = ("cw_text", "cw_lines", "cw_dropped")

_BLANK = b" \t\n\x0b\x0c\r"
_LEVELS = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)


def long_keys(data: bytes, least_chars: int = LEAST_CHARS) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, the numbers of those with a long key, and 16-byte digests of these keys."""
    lines = data.split(b"\n")
    at, digests = [], []
    for k, line in enumerate(lines):
        if len(line) >= least_chars:
            key = line.strip(_BLANK)
            if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
                at.append(k)
                digests.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, at, digests


def _halves(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The distinct hashes (hi, lo) of every document's long keys, with docs' columns but text, all of them numbers."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, counts = [], []
            for text in batch.column("text").to_pylist():
                found = set(long_keys(text.encode("utf-8", "surrogatepass"), least_chars)[2]) if text else set()
                parts.extend(found)
                counts.append(len(found))
            both = _halves(parts).view(np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=[*names, "hi", "lo"])

    rows = docs.select(*(F.col(c).cast("long").alias(c) for c in names), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "hi", "lo"]))


def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place in a level's bit array, from both halves of a hash."""
    x = (hi ^ np.uint64((level + 1) * int(_MUL) & (2**64 - 1))) * _MUL + lo
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class Shard:
    """A minimal perfect hash over some 128-bit hashes, and arrays by index."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.levels, self.prints, self.counts, self.keepers = levels, prints, counts, keepers
        self.sizes = [len(x) * 8 for x in levels]
        # Bits set before each byte, over all levels.
        ones = [np.unpackbits(x[:, None], axis=1).sum(axis=1, dtype=np.int64) for x in levels]
        first = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.before = [np.cumsum(x) - x + f for x, f in zip(ones, first, strict=False)]

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        """A shard over distinct hashes (hi, lo)."""
        levels, left = [], np.arange(len(hi))
        while len(left):
            if len(levels) == _LEVELS:
                raise RuntimeError("hashes of a shard do not part")
            size = max(8, -(-2 * len(left) // 8) * 8)
            slot = _slot(hi[left], lo[left], len(levels), size)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[slot]]
        shard = cls(levels, np.zeros(0, np.uint64), counts, keepers)
        order = np.empty(len(hi), np.int64)
        order[shard.index(hi, lo)] = np.arange(len(hi))
        return cls(levels, lo[order], counts[order], keepers[order])

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each hash; any number, or -1, for hashes the shard was not built over."""
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            slot = _slot(hi[left], lo[left], level, size).astype(np.int64)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            held = bits[byte]
            hit = (held >> (7 - bit)) & 1 == 1
            # packbits puts the first place into the highest bit.
            earlier = np.unpackbits((held[hit] >> (8 - bit[hit].astype(np.uint16))).astype(np.uint8)[:, None], axis=1).sum(axis=1)
            out[left[hit]] = self.before[level][byte[hit]] + earlier
            left = left[~hit]
            if not len(left):
                break
        return out

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hashes: whether they have an entry, its count and its keeper."""
        if not len(self.prints):
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        at = self.index(hi, lo)
        known = (at >= 0) & (self.prints[at] == lo)
        return known, self.counts[at], self.keepers[at]

    def to_row(self) -> list[bytes]:
        sizes = np.array([len(x) for x in self.levels], np.int64)
        return [sizes.tobytes(), b"".join(x.tobytes() for x in self.levels), self.prints.tobytes(), self.counts.astype(np.int64).tobytes(), self.keepers.tobytes()]

    @classmethod
    def from_row(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes) -> Shard:
        edges = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64))))
        flat = np.frombuffer(bits, np.uint8)
        levels = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return cls(levels, np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(keepers, np.int64))


_PARTS = ("sizes", "bits", "prints", "counts", "keepers")
_SHARDS = "shard long, " + ", ".join(f"{c} binary" for c in _PARTS)
#: Stands for the keeper of a line that only rows without a doc_id hold.
_NOBODY = np.iinfo(np.int64).min


def _shard_of(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards))


def index(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards over hashes found in at least least_docs documents, as rows, and their number."""
    found = hashes(docs, least_chars).groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    found = materialize(found.where((F.col("n") >= least_docs) & F.col("keeper").isNotNull()), "line-hashes")
    shards = max(1, -(-found.count() // shard_keys))
    rows = found.withColumn("shard", _shard_of(shards)).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def built() -> pa.RecordBatch:
            part = pa.concat_batches(held)
            column = {c: part.column(c).to_numpy() for c in ("hi", "lo", "n", "keeper")}
            shard = Shard.build(column["hi"].view(np.uint64), column["lo"].view(np.uint64), column["n"], column["keeper"])
            values = [pa.array([part.column("shard")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in shard.to_row())]
            return pa.RecordBatch.from_arrays(values, names=["shard", *_PARTS])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column("shard")[0] != batch.column("shard")[a]:
                    yield built()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield built()

    return materialize(rows.mapInArrow(run, _SHARDS), "line-shards"), shards


class _Cutter:
    """Drops lines of texts by a function from hashes and doc_ids to whether they go."""

    def __init__(self, least_chars: int):
        self.least_chars = least_chars

    def cut(self, texts: list, gone) -> tuple[list, list[int], list[int]]:
        """Texts without the lines that go, and how many lines they had and lost; gone(hi, lo, text number) is asked once."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        keyed = [long_keys(d, self.least_chars) for d in data]
        both = _halves([x for _, _, digests in keyed for x in digests])
        of = np.repeat(np.arange(len(texts)), [len(at) for _, at, _ in keyed])
        drop = gone(both[:, 0], both[:, 1], of) if len(of) else np.zeros(0, bool)
        out, totals, lost, place = [], [], [], 0
        for text, (lines, at, _) in zip(texts, keyed, strict=True):
            goes = {k for k, x in zip(at, drop[place : place + len(at)].tolist(), strict=True) if x}
            place += len(at)
            if goes:
                text = b"\n".join(x for k, x in enumerate(lines) if k not in goes).decode("utf-8", "surrogatepass")
            out.append(text)
            totals.append(len(lines))
            lost.append(len(goes))
        return out, totals, lost


def _schema(docs: DataFrame, without: str | None = None) -> tuple[T.StructType, list[str]]:
    names = [c for c in docs.columns if c != without]
    added = [free_name(c, docs) for c in ADDED]
    fields = [T.StructField(c, docs.schema[c].dataType) for c in names]
    return T.StructType([*fields, *map(T.StructField, added, (T.StringType(), T.LongType(), T.LongType()))]), names


def _with_text(batch: pa.RecordBatch, names: list[str], schema: T.StructType, texts: list, totals: list[int], lost: list[int]) -> pa.RecordBatch:
    columns = [batch.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(lost, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _by_broadcast(docs: DataFrame, shards: DataFrame, n: int, least_docs: int, least_chars: int) -> DataFrame:
    rows = {r["shard"]: [bytes(r[c]) for c in _PARTS] for r in shards.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema, names = _schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Shard.from_row(*row) for k, row in shared.value.items()}
        cutter = _Cutter(least_chars)
        for batch in batches:
            ids = np.array([_NOBODY if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)

            def gone(hi: np.ndarray, lo: np.ndarray, of: np.ndarray) -> np.ndarray:
                drop = np.zeros(len(hi), bool)
                home = hi.view(np.int64) % n
                for k in np.unique(home).tolist():
                    if k in held:
                        at = np.flatnonzero(home == k)
                        known, count, keeper = held[k].probe(hi[at], lo[at])
                        drop[at] = known & (count >= least_docs) & (keeper != ids[of[at]])  # noqa: B023
                return drop

            yield _with_text(batch, names, schema, *cutter.cut(batch.column("text").to_pylist(), gone))

    return docs.mapInArrow(run, schema)


def _by_shuffle(docs: DataFrame, shards: DataFrame, n: int, least_docs: int, least_chars: int, probes: int) -> DataFrame:
    """As _by_broadcast, with hashes dealt to the shards."""
    row = free_name("cw_row", docs)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
    # Row numbers in place of ids; the id comes along for the keeper.
    keyed = materialize(hashes(rows.select(F.col(row).alias("row"), "doc_id", "text"), least_chars), "line-probes")
    keyed = keyed.withColumn("shard", _shard_of(n))
    copies = keyed.groupBy("shard").agg(F.ceil(F.count("*") / probes).alias("copies"))
    none = [F.lit(None).cast("long").alias(c) for c in ("row", "doc_id", "hi", "lo")]
    arrays = shards.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    arrays = arrays.select("shard", "copy", *none, *_PARTS)
    asked = keyed.join(F.broadcast(copies) if n <= 100_000 else copies, "shard")
    blank = [F.lit(None).cast("binary").alias(c) for c in _PARTS]
    asked = asked.select("shard", F.pmod(F.xxhash64("row", "hi"), F.col("copies")).alias("copy"), "row", "doc_id", "hi", "lo", *blank)
    both = arrays.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("sizes").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("copy").to_pylist(), strict=True))
            arrays_at = set(np.flatnonzero(batch.column("sizes").is_valid().to_numpy(zero_copy_only=False)).tolist())
            edges = sorted({0, len(keys), *arrays_at, *(k + 1 for k in arrays_at), *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])})
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a in arrays_at:
                    name, shard = keys[a], Shard.from_row(*(batch.column(c)[a].as_py() for c in _PARTS))
                elif shard is not None and name == keys[a]:
                    part = batch.slice(a, b - a)
                    hi, lo = (part.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
                    ids = part.column("doc_id").fill_null(_NOBODY).to_numpy()
                    known, count, keeper = shard.probe(hi, lo)
                    goes = known & (count >= least_docs) & (keeper != ids)
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(goes)) for c in ("row", "hi", "lo")], names=["row", "hi", "lo"])

    dropped = both.mapInArrow(run, "row long, hi long, lo long")
    lost = free_name("cw_lost", rows)
    marks = dropped.groupBy("row").agg(F.collect_set(F.struct("hi", "lo")).alias(lost)).withColumnRenamed("row", row)
    met = rows.join(marks, row, "left").drop(row)
    schema, names = _schema(met, lost)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(least_chars)
        for batch in batches:
            sets = [{(x["hi"], x["lo"]) for x in found or ()} for found in batch.column(lost).to_pylist()]

            def gone(hi: np.ndarray, lo: np.ndarray, of: np.ndarray) -> np.ndarray:
                return np.array([(h, c) in sets[k] for h, c, k in zip(hi.view(np.int64).tolist(), lo.view(np.int64).tolist(), of.tolist(), strict=True)], bool)  # noqa: B023

            yield _with_text(batch, names, schema, *cutter.cut(batch.column("text").to_pylist(), gone))

    return met.mapInArrow(cut, schema)


def cut(
    docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES, probes: int = PROBES
) -> DataFrame:
    """docs with cw_text, the text without lines found elsewhere, cw_lines, lines before, and cw_dropped, lines dropped."""
    shards, n = index(docs.select("doc_id", "text"), least_docs, least_chars, shard_keys)
    size = shards.agg(F.coalesce(F.sum(sum(F.length(c) for c in _PARTS)), F.lit(0)).alias("size")).first()["size"]
    if size <= broadcast_bytes:
        return _by_broadcast(docs, shards, n, least_docs, least_chars)
    return _by_shuffle(docs, shards, n, least_docs, least_chars, probes)


def clean(docs: DataFrame, **how) -> DataFrame:
    """docs, same columns, without the lines found elsewhere; n_chars follows where there is one."""
    done, (text, _, gone) = cut(docs, **how), [free_name(c, docs) for c in ADDED]
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(gone) > 0, length).otherwise(F.col("n_chars"))
    return done.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("cw_lines").alias("n_lines"), F.col("cw_dropped").alias("n_dropped"), F.sha2(F.coalesce("cw_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """WITH l AS (SELECT r, doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""
