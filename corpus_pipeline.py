"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in shared storage and read again as the next stage's docs. All but the
last return the columns of documents; the last adds copies, in place of such a column
where there is one. Stages that work in Python make Arrow batches smaller, for the session (`small_batches`).

Defined results, besides those of the operators: a document whose text is null or has
no letters has no language and goes in the first stage; a null doc_id is never a
duplicate of another; repeated rows count as duplicates of one another and stay
together with the one that is kept; a null source is a source of its own; columns beyond
those of documents are carried through; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import decontaminate, langid, minhash, mixing, pii
from caseweave.llm.common import free_name, materialize, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble a known language."""
    small_batches(spark)
    return langid.keep(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return minhash.dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that mostly consist of them go."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each row with how often (copies).

    Rows are numbered and stored first, so that of several rows of one doc_id (or of
    none) each has its own count.
    """
    row, n = free_name("cw_row", docs), "copies"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    sizes = mixing.sizes_of(rows.select("text", "doc_id", "source", F.col(row).alias("row")), "row")
    taken = mixing.copies(materialize(sizes, "mix-sizes")).where("copies > 0").select(F.col("row").alias(row), "copies")
    return rows.drop(n).join(taken, row).drop(row)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark_free),
    ("personal_data", personal_data),
    ("mix", mixture),
]

#: Language profiles, sketches and trees have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
