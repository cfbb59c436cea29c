"""Substring dedup over sliding sentence spans.

A text is cut into units: sentences, ended by . ! ? their full-width forms or a line
end. Inside a sentence of more than `UNIT_WORDS` words further cuts are chosen by content: the
last smallest of each `UNIT_WORDS` consecutive hashes of two words starts a unit. So two
occurrences of a passage are cut alike wherever they stand, but for the first and last
`UNIT_WORDS` words, and no unit is longer than `UNIT_WORDS` words but at a sentence's ends (twice that).

A span is a shortest run of at least `SPAN_UNITS` consecutive units and `SPAN_WORDS`
words, one that starts and one that ends at every unit, so a repeated passage that holds
a span is covered from its first unit to its last. Spans are hashed to 95 bits over their
normalised words and joined over all documents. The first occurrence of a span is
the one of smallest doc_id, then position; the units under any other occurrence are
removed from the text, within a document as well. A document is a doc_id with a text: rows of one
doc_id with different texts are documents each, numbered from 0 in order of a 64-bit digest of the text.

Scale. Span rows hold numbers only. One aggregation, combined before its shuffle, finds the
hashes that occur twice or more with their first occurrence; they are stored, and the spans
join them in a plain join of two stored tables, which Spark splits where one hash is
very common. A passage of any frequency costs rows in proportion to its occurrences.
Texts are shuffled once, by doc_id and number. A span's place is one long: the number of the
text, the first unit, whether the span has occurred before in the text, and how many more units follow, of
which there are fewer than `SPAN_WORDS`.

Defined results: a null or empty text has no units and stays; rows with a null
doc_id are left alone; repeated rows of a doc_id with the same text count as one document, are cut
alike and keep their first occurrence of each span; an empty table gives an empty
result; all columns, whatever their names, are kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import WORD_BYTES, free_name, materialize, table

UNIT_WORDS = 12
SPAN_UNITS = 3
SPAN_WORDS = 25
ADDED = ("cw_text", "cw_removed", "cw_units")
#: Bits of a place: below _AGAIN the units after the first, _AGAIN, below _NUMBER the first unit, above it the number of the text.
_UNIT, _NUMBER = 8, 40
_AGAIN = 1 << (_UNIT - 1)

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
#: Full-width full stop, exclamation mark, question mark and dot, as UTF-8; each three bytes long.
_WIDE_ENDS = tuple(c.encode() for c in "\u3002\uff01\uff1f\uff0e")
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for k in range(n):
        out[k] = x
        x = x * base & (2**64 - 1)
    return out


class _WordHashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Hasher:
    """Hashes of word runs by differences of prefix sums; keeps word hashes and powers between texts."""

    def __init__(self) -> None:
        self.words = _WordHashes()
        self.latest: tuple[list[bytes], np.ndarray] = ([], np.zeros(0, np.uint64))
        self.grow(_STEP)

    def grow(self, n: int) -> None:
        self.powers = [(_powers(p, n), _powers(pow(p, -1, 2**64), n)) for p in (_P, _Q)]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Hashes of a text's words; asked again for the same list, the same array."""
        if self.latest[0] is not words:
            if len(self.words) > 500_000:
                self.words.clear()
            self.latest = words, np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        return self.latest[1]

    def prefixes(self, words: list[bytes]) -> list[np.ndarray]:
        if len(words) >= len(self.powers[0][0]):
            self.grow(2 * len(words))
        ids = self.ids(words)
        return [np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * up[: len(ids)]))) for up, _ in self.powers]

    def runs(self, prefixes: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit hash of the words lo..hi-1 of each run."""
        a, b = ((p[hi] - p[lo]) * down[lo] for p, (_, down) in zip(prefixes, self.powers, strict=True))
        a = (a ^ (a >> np.uint64(29))) * np.uint64(_Q)
        b = (b ^ (b >> np.uint64(31))) * np.uint64(_P)
        return (a ^ (a >> np.uint64(32))).view(np.int64), (b >> np.uint64(33)).astype(np.int32)


def _content_cuts(ids: np.ndarray, w: int = UNIT_WORDS) -> np.ndarray:
    """Place of the last smallest of each w consecutive hashes, by window; neighbours are at most w apart."""
    n = max(len(ids) - w + 1, 0)
    at, least = np.full(n, w - 1), ids[w - 1 :].copy()
    for k in range(w - 2, -1, -1):
        less = ids[k : k + n] < least
        np.copyto(least, ids[k : k + n], where=less)
        at[less] = k
    return at + np.arange(n)


def units(data: bytes, hasher: Hasher | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Byte offset and first word of each unit of a text, and its words."""
    if not data.isascii():
        for end in _WIDE_ENDS:
            data = data.replace(end, b"  \n")
    plain = data.translate(WORD_BYTES)
    words = plain.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    is_word = np.frombuffer(plain, np.uint8) != 0x20
    starts = np.flatnonzero(is_word & ~np.concatenate(([False], is_word[:-1])))
    sentence = np.cumsum(_ENDS[np.frombuffer(data, np.uint8)])[starts]
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    at = first
    # Windows of pairs that lie inside one sentence.
    inside = sentence[UNIT_WORDS:] == sentence[:-UNIT_WORDS]
    if inside.any():
        ids = (hasher or Hasher()).ids(words)
        # Two words make fewer ties than one; the pair that begins with a sentence's last word is none of its own.
        pairs = (ids[:-1] * np.uint64(_P)) ^ (ids[1:] * np.uint64(_Q))
        pairs ^= pairs >> np.uint64(32)
        starts_unit = np.zeros(len(words), bool)
        starts_unit[first] = True
        starts_unit[_content_cuts(pairs)[inside]] = True
        at = np.flatnonzero(starts_unit)
    return starts[at], at, words


def spans(first_word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of every span."""
    n = len(first_word)
    edge = np.append(first_word, n_words)
    unit = np.arange(n)
    last = np.maximum(unit + SPAN_UNITS - 1, np.searchsorted(edge, edge[:-1] + SPAN_WORDS) - 1)
    begin = np.minimum(unit - SPAN_UNITS + 1, np.searchsorted(edge, edge[1:] - SPAN_WORDS, side="right") - 1)
    lo = np.concatenate((unit[last < n], begin[begin >= 0]))
    hi = np.concatenate((last[last < n], unit[begin >= 0]))
    both = np.unique(lo * (n + 1) + hi)
    return both // (n + 1), both % (n + 1)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """docs with the number of each row's text among the different texts of its doc_id, nearly always 0, and whether there are others."""
    digest = F.xxhash64("text")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi")
    texts = rows.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) - 1).cast("long")
    number = F.when(number < 2 ** (63 - _NUMBER), number).otherwise(F.raise_error(F.lit("too many different texts of one doc_id")))
    texts = materialize(texts.select(F.col("doc_id").alias(f"{name}_id"), F.col("digest").alias(f"{name}_digest"), number.alias(name)), "spans-texts")
    if texts.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long")), False
    met = docs.join(texts, (F.col("doc_id") == F.col(f"{name}_id")) & (digest == F.col(f"{name}_digest")), "left")
    return met.drop(f"{name}_id", f"{name}_digest").withColumn(name, F.coalesce(name, F.lit(0).cast("long"))), True


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, c, doc_id, at): every span of every document (doc_id, number, text) by hash, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, number, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                _, first, words = units((text or "").encode("utf-8", "surrogatepass"), hasher)
                if len(first) < SPAN_UNITS or len(words) < SPAN_WORDS:
                    continue
                lo, hi = spans(first, len(words))
                edge = np.append(first, len(words))
                h, c = hasher.runs(hasher.prefixes(words), edge[lo], edge[hi + 1])
                order = np.lexsort((c, h))
                again = np.zeros(len(lo), np.int64)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
                at = (number << _NUMBER) + (lo.astype(np.int64) << _UNIT) + again * _AGAIN + (hi - lo)
                for held, x in zip(out, (h, c, np.full(len(lo), doc_id), at), strict=True):
                    held.append(x)
            if out[0]:
                columns = [pa.array(np.concatenate(x)) for x in out]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "doc_id", "at"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "number", "text")
    return rows.mapInArrow(run, "h long, c int, doc_id long, at long")


def repeats(docs: DataFrame, several: bool = True) -> DataFrame:
    """(doc_id, number, cuts array<struct<lo, hi>>) of documents (doc_id, number, text): unit ranges under a span that occurs earlier.

    several tells whether there are numbers other than 0; without them a document is its doc_id.
    """
    every = materialize(occurrences(docs), "spans-all", "zstd")
    doc = F.struct("doc_id", F.shiftright("at", _NUMBER).alias("number")) if several else F.col("doc_id")
    # A document counts as often as the span occurs in it; its first occurrence is told by the place.
    first = every.groupBy("h", "c").agg(F.min(doc).alias("first"), F.count("*").alias("n"))
    twice = materialize(first.where("n > 1").select("h", "c", "first"), "spans-repeated")
    again = F.col("at").bitwiseAND(F.lit(_AGAIN)) != 0
    later = every.join(twice, ["h", "c"]).where((doc > F.col("first")) | ((doc == F.col("first")) & again))
    bits = lambda shift, n: F.shiftright("at", shift).bitwiseAND(F.lit(2**n - 1)).cast("int")
    lo = bits(_UNIT, _NUMBER - _UNIT)
    cut = F.struct(lo.alias("lo"), (lo + bits(0, _UNIT - 1)).alias("hi"))
    return later.groupBy("doc_id", F.shiftright("at", _NUMBER).alias("number")).agg(F.array_sort(F.collect_set(cut)).alias("cuts"))


def _covered(cuts: list[dict], n: int) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    for cut in cuts:
        depth[cut["lo"]] += 1
        depth[cut["hi"] + 1] -= 1
    return np.cumsum(depth[:-1]) > 0


def _without(data: bytes, at: np.ndarray, gone: np.ndarray) -> bytes:
    """data without the units that are gone; a unit reaches up to the next one's first word."""
    edge = np.append(at, len(data)).tolist()
    kept = [data[: edge[0]]] if len(at) else [data]
    kept += [data[lo:hi] for lo, hi, g in zip(edge, edge[1:], gone.tolist(), strict=False) if not g]
    return b"".join(kept)


def cut(docs: DataFrame) -> DataFrame:
    """docs with cw_text, the text without repeats, cw_removed, words removed, and cw_units, units removed."""
    names = docs.columns
    number = free_name("cw_text_number", docs)
    rows, several = _numbered(docs, number)
    marks = repeats(rows.select("doc_id", F.col(number).alias("number"), "text"), several)
    marks = marks.select(*(F.col(c).alias(free_name(f"cw_{c}", docs)) for c in ("doc_id", "number", "cuts")))
    key, which, cuts_name = marks.columns
    rows = rows.join(marks, (F.col("doc_id") == F.col(key)) & (F.col(number) == F.col(which)), "left").drop(key, which, number)
    added = [free_name(c, docs) for c in ADDED]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *map(T.StructField, added, (T.StringType(), T.LongType(), T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts, removed, counts = [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column(cuts_name).to_pylist(), strict=True):
                words_gone = units_gone = 0
                if text and cuts:
                    data = text.encode("utf-8", "surrogatepass")
                    at, first, words = units(data, hasher)
                    gone = _covered(cuts, len(at))
                    text = _without(data, at, gone).decode("utf-8", "surrogatepass")
                    words_gone, units_gone = int(np.diff(np.append(first, len(words)))[gone].sum()), int(gone.sum())
                texts.append(text)
                removed.append(words_gone)
                counts.append(units_gone)
            columns = [batch.column(c) for c in names]
            columns += [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """docs, same columns, with repeats removed from text; n_chars follows where there is one."""
    done, (text, _, gone) = cut(docs), [free_name(c, docs) for c in ADDED]
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(gone) > 0, length).otherwise(F.col("n_chars"))
    return done.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words and units removed, and a digest of the text that stays."""
    done = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("cw_units").alias("n_units_removed"),
        F.col("cw_removed").alias("n_words_removed"),
        (F.col("cw_units") > 0).alias("repeats"),
        F.sha2(F.coalesce("cw_text", F.lit("")), 256).alias("text_sha256"),
    )
