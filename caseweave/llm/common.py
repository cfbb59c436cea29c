"""What several corpus operators share: shared-storage tables, word splitting, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator marks for broadcast after counting it.
BROADCAST_ROWS = 20_000

#: Rows and bytes of an Arrow batch that a task works on at once (see `slices`).
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20

#: Most bytes of an Arrow batch between the JVM and Python (see `small_batches`).
BATCH_BYTES = 4 << 20

#: Bytes that separate words become a space and A-Z become a-z; UTF-8 bytes above 0x7F stay.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, in views of about SLICE_BYTES and at most SLICE_ROWS.

    A batch may hold 10,000 texts; so only a few of them are Python objects at once, and what is
    made of them goes back to the JVM in batches as small.
    """
    for batch in batches:
        step = min(SLICE_ROWS, max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in Arrow batches of about BATCH_BYTES, instead of 64 MB or 10,000 rows.

    Each task holds a batch in the JVM and in Python, a few times over. The setting is read when a
    result is worked out, so it is not put back; no result depends on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """name, or name with underscores where df already has such a column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="caseweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df once to the shared folder, compressed by codec, and go on from the files.

    Cuts the lineage, and survives the loss of any executor since the files are
    not kept by executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast only if it has been counted to hold few rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component) for every vertex of edges (src, dst); component is the smallest id reachable.

    Each round points every vertex at its smallest neighbour, follows the pointers
    two doublings far, and goes on with the graph of the vertices pointed at, without
    loops and repeated edges. Edges inside a star vanish in one round, and a path
    shrinks at least fourfold, so rounds grow with the logarithm of the longest path.
    """
    edges = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = materialize(edges.distinct(), f"{tag}-edges-0")
    whole = edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    for k in range(1, 200):
        if edges.isEmpty():
            return whole
        ends = edges.select("src", "dst").union(edges.select("dst", "src"))
        near = ends.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("to"))
        for _ in range(2):
            on = near.select(F.col("id").alias("to"), F.col("to").alias("next"))
            near = materialize(near.join(on, "to").select("id", F.col("next").alias("to")), f"{tag}-near-{k}")
        step = near.select(F.col("id").alias("component"), "to")
        if k == 1:
            whole = near.select("id", F.col("to").alias("component"))
        else:
            whole = whole.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            whole = materialize(whole, f"{tag}-whole-{k}")
        low = near.select(F.col("id").alias("src"), F.col("to").alias("a"))
        high = near.select(F.col("id").alias("dst"), F.col("to").alias("b"))
        rest = edges.join(low, "src").join(high, "dst").where("a <> b")
        rest = rest.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        edges = materialize(rest, f"{tag}-edges-{k}")
    raise RuntimeError("components did not settle")
