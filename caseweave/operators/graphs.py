"""Helpers on graphs and on all pairs of a table's rows: blocks compared in tasks, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_place(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares; a temporary one on a local master without such a folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="caseweave-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there."""
    path = shared_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_block_pairs(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows for each pair of blocks (lo, hi) they are in: left for those of lo, own where lo = hi.

    Rows are dealt by a hash of key to as many blocks as there are rows by size, so a
    group of lo and hi holds about twice that many and every two rows meet once.
    """
    n = rows.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("blocks"))
    held = rows.crossJoin(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return held.select(
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own"), *rows.columns,
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) reach from each id of nodes, itself included.

    Each round takes the smallest label among neighbours, then that label's own, until
    nothing changes. Labels are written to the shared folder after each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        hop = labels.select(F.col("id").alias("now"), F.col("component").alias("then"))
        step = stored(step.join(hop, "now", "left").select("id", "was", F.least("now", "then").alias("component")), "labels")
        labels = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return labels
