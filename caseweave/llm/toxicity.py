"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are 0 (not toxic), 1 and 2. Labels say only whether a document is toxic;
toxic training documents are graded 1 or 2 by whether the share of their words
that mark toxic documents lies below the median or not. The model has one weight
per feature, shared by all grades, and one threshold per step:

    P(grade >= j) = sigmoid(w . x - t_j),   t_1 < t_2,

so the expected severity is the sum of these probabilities.

Features are words and word beginnings (4 to 8 letters), with log(1 + count). The
`N_FEATURES` features that tell labelled classes apart best (log odds over its
standard error) are kept, counted by Spark over a bounded sample: at most about
`TRAIN_DOCS` labelled documents, those of smallest hashed doc_id, each text once, under
its smallest doc_id and highest label; rows are put in order before fitting, so runs agree.
The weights are fitted by numpy on the driver from that sample's sparse rows, the
only rows that reach it. A third of the sample is held back to choose the lowest
probability that flags at most `FALSE_SHARE` of its clean documents. Scoring is one
scan of whole texts without a shuffle.

Defined results: a null or empty text has no features and gets the model's base
severity, grade 0; null ids pass through; null labels are not learned, of several
labels for a document the highest counts; repeated rows are scored each; without
labels of both kinds every severity is 0; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import materialize, maybe_broadcast, table, words_of

TRAIN_DOCS = 16_000
N_FEATURES = 4_000
MIN_DOCS = 6
BEGINNINGS = (4, 5, 6, 7, 8)
STEPS = 400
RATE = 0.3
RIDGE = 2e-4
FALSE_SHARE = 0.0005
FLUSH = 150_000


def features_of(word: bytes) -> list[str]:
    text = word.decode("utf-8", "replace")
    return [text] + [f"{text[:k]}*" for k in BEGINNINGS if len(text) > k]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by feature, thresholds, and the probability from which a document is flagged."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, flag: float):
        self.weights, self.steps, self.flag = weights, steps, flag

    def prepare(self) -> None:
        self.index = {f: k for k, f in enumerate(self.weights)}
        self.w = np.array(list(self.weights.values()))
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def rows(self, text: str | None) -> tuple[list[int], list[float], int]:
        """Sparse features of a text, and its number of words."""
        counts: Counter[int] = Counter()
        words = words_of(text)
        for word in words:
            at = self.seen.get(word)
            if at is None:
                if len(self.seen) > 500_000:
                    self.seen.clear()
                at = self.seen[word] = tuple(k for f in features_of(word) if (k := self.index.get(f)) is not None)
            for k in at:
                counts[k] += 1
        return list(counts), np.log1p(np.fromiter(counts.values(), float, len(counts))).tolist(), len(words)

    def steps_of(self, text: str | None) -> np.ndarray:
        """P(grade >= j) for each step."""
        at, values, _ = self.rows(text)
        return _sigmoid(float(np.dot(self.w[at], values)) - self.steps) if at else _sigmoid(-self.steps)


def _sample(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """(doc_id, text, toxic, held) of a bounded, fixed sample of labelled documents."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    given = given.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    lot = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("l_id")), F.lit(1 << 30))
    share = min(1.0, train_docs / max(1, given.count()))
    given = given.where(lot("toxicity") < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(maybe_broadcast(given, 2 * train_docs), F.col("doc_id") == F.col("l_id"))
    # Of equal texts the smallest doc_id and the highest label count, so that every run and partitioning learns the same.
    rows = rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    held = F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(1 << 30)) % 3 == 0
    return materialize(rows.select("doc_id", "text", "toxic", held.alias("held")), "toxicity-sample")


def _select(sample: DataFrame, n_features: int) -> list[tuple[str, float]]:
    """The features with the largest log odds between classes, in standard errors, by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for toxic, found in enumerate(counts):
                kind = pa.array([toxic] * len(found), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), kind, pa.array(list(found.values()), pa.int64())], names=["feature", "toxic", "n"])
                found.clear()

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[int(toxic > 0)].update({f for w in set(words_of(text)) for f in features_of(w)})
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield from flush()
        yield from flush()

    rows = sample.where(~F.col("held")).select("text", "toxic")
    n = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return []
    by = rows.mapInArrow(run, "feature string, toxic int, n long").groupBy("feature")
    by = by.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    by = by.where(F.col("a") + F.col("b") >= MIN_DOCS)
    p, q = (F.col("a") + 0.5) / (n[True] + 1), (F.col("b") + 0.5) / (n[False] + 1)
    z = F.log(p / (1 - p) * (1 - q) / q) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = by.select("feature", z.alias("z")).orderBy(F.desc(F.abs("z")), "feature").limit(n_features)
    return [(r["feature"], r["z"]) for r in top.collect()]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, n_features: int = N_FEATURES) -> Model:
    sample = _sample(docs, labels, train_docs)
    chosen = _select(sample, n_features)
    if not chosen:
        return Model({}, np.array([40.0, 41.0]), 1.0)
    shared = sample.sparkSession.sparkContext.broadcast([f for f, _ in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(dict.fromkeys(shared.value, 0.0), np.zeros(2), 1.0)
        model.prepare()
        for batch in batches:
            rows = [model.rows(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("toxic"), batch.column("held"),
                    pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["doc_id", "toxic", "held", "at", "x", "n_words"],
            )

    wide = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "held", "text")
    kind = wide.schema["doc_id"].dataType.simpleString()
    rows = wide.mapInArrow(run, f"doc_id {kind}, toxic int, held boolean, at array<int>, x array<double>, n_words long").collect()
    rows.sort(key=lambda r: r["doc_id"])

    doc = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([k for r in rows for k in r["at"]], np.int64)
    x = np.array([v for r in rows for v in r["x"]])
    toxic, held = np.array([r["toxic"] > 0 for r in rows]), np.array([r["held"] for r in rows])
    marks = np.array([z >= 5 for _, z in chosen])
    rate = np.bincount(doc, np.expm1(x) * marks[at], len(rows)) / np.array([max(1, r["n_words"]) for r in rows])
    severe = rate >= np.median(rate[toxic & ~held]) if (toxic & ~held).any() else toxic
    grade = np.where(toxic, 1 + severe, 0)

    # Gradient descent on the sum over steps of the binary losses of grade >= j; the step gap stays positive.
    use = ~held
    pick = use[doc]
    d, a, v = doc[pick], at[pick], x[pick]
    above = np.stack([grade >= 1, grade >= 2], axis=1)[use]
    place = np.cumsum(use) - 1
    d, n = place[d], int(use.sum())
    w, low, gap = np.zeros(len(chosen)), 2.0, 1.0
    past_w, past_t = np.full(len(w), 1e-8), np.full(2, 1e-8)
    for _ in range(STEPS):
        score = np.bincount(d, v * w[a], n)
        err = _sigmoid(score[:, None] - np.array([low, low + gap])) - above
        slope = np.bincount(a, v * err.sum(axis=1)[d], len(w)) / n + RIDGE * w
        turn = np.array([-err.sum() / n, -err[:, 1].sum() / n])
        past_w, past_t = past_w + slope**2, past_t + turn**2
        w = w - RATE * slope / np.sqrt(past_w)
        low, gap = low - RATE * turn[0] / np.sqrt(past_t[0]), max(0.05, gap - RATE * turn[1] / np.sqrt(past_t[1]))

    score = _sigmoid(np.bincount(doc, x * w[at], len(rows)) - low)
    clean = np.sort(score[held & ~toxic])[::-1]
    flag = max(0.2, float(clean[int(FALSE_SHARE * len(clean))]) + 1e-6) if len(clean) else 0.5
    return Model(dict(zip((f for f, _ in chosen), w.tolist(), strict=True)), np.array([low, low + gap]), min(flag, 0.9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row of docs; severity is the expected grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.prepare()
        for batch in batches:
            steps = np.array([model.steps_of(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            toxic = steps[:, 0] >= model.flag
            grade = np.where(toxic, 1 + (steps[:, 1] >= 0.5), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(steps.sum(axis=1)), pa.array(steps[:, 0]), pa.array(grade, pa.int32()), pa.array(toxic)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("severity", T.DoubleType()),
            T.StructField("p_toxic", T.DoubleType()),
            T.StructField("grade", T.IntegerType()),
            T.StructField("toxic", T.BooleanType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
