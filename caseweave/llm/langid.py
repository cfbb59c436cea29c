"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent character n-grams (1 to 3 letters, word
ends marked by a space) in order of frequency. A document is compared by the
out-of-place distance: for each of its own most frequent n-grams the difference of
the two ranks, or the profile's length where the profile lacks the n-gram. The
nearest profile names the language; equal distances go to the smaller name. The
score is 1 - distance / (profile length * n-grams compared).

Fitting uses a bounded sample: at most about `train_docs` documents a language,
those whose hashed doc_id is smallest, whole texts. Counts are summed by Spark,
and the only thing sent to executors is `profile_size` n-grams a language.
Prediction is one scan without a shuffle, over whole texts.

Defined results: `und` with score 0 for a null text, a text without letters, or
where nothing could be learned; null languages are not learned; a null doc_id
counts as the empty string; repeated rows are predicted each; an empty table
gives an empty result; further columns are ignored by `predict` and kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import slices, table

SIZES = (1, 2, 3)
PROFILE_SIZE = 400
TRAIN_DOCS = 4_000
MIN_SCORE = 0.1
UNKNOWN = "und"
_SPACE, _BITS = 32, 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, packed 21 bits a character, with their counts; none if it has no letter."""
    empty = np.zeros(0, np.int64)
    if not text:
        return empty, empty
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return empty, empty
    points = np.concatenate(([_SPACE], np.where(letter, points, _SPACE), [_SPACE]))
    points = points[np.concatenate(([True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)))]
    found, packed = [], points
    for n in range(1, max(SIZES) + 1):
        if n > 1:
            packed = (packed[:-1] << _BITS) | points[n - 1 :]
        if n in SIZES:
            found.append(packed)
    every = np.concatenate(found)
    return np.unique(every[every != _SPACE], return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by code points."""
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Ranks of all profiles' n-grams, as one matrix of languages by n-grams."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(by_lang), size
        self.grams = np.array(sorted({g for grams in by_lang.values() for g in grams}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.grams, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), self.size)
        if not len(own) or not len(self.grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[:, at]
        apart = np.abs(ranks - np.arange(len(own)))
        apart = np.where((ranks < 0) | (self.grams[at] != own), self.size, apart).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], max(0.0, 1.0 - float(apart[best]) / (self.size * len(own)))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, profile_size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from text and lang of documents that are not held out."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Profiles({}, profile_size)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, train_docs / n))) for k, n in per.items()))
    lot = F.pmod(F.xxhash64(F.lit("language"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    rows = rows.where(lot < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(ngrams(text))
            for lang, several in found.items():
                grams, where = np.unique(np.concatenate([g for g, _ in several]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in several]), len(grams)).astype(np.int64)
                langs = pa.array([lang] * len(grams), pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= profile_size).collect()
    by_lang: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_lang, profile_size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, profiles: Profiles, min_score: float = MIN_SCORE) -> DataFrame:
    """docs, same columns, without documents that resemble no known language."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
