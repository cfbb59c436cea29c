"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets. Source number k (by code point, null last) weighs 1, 2, 3, 1, 2, 3, ...;
the targets share the words of all documents by weight. No target exceeds
`max_repeat` times its source's words; what is over goes to the other sources by
weight until none is above. That fixpoint is a water level, found in closed form
by one ordered window over the per-source table.

Expected copies. Within a source, documents are grouped by floor(log2(words + 1)).
Longer strata are favoured: a stratum's expected copies are min(max_repeat,
level * (stratum + 1)), the level again being the one that meets the target.
The whole part of the expected copies is certain. The rest is an inclusion
probability p, and documents are ranked by Pareto's order statistic

    (u / (1 - u)) / (p / (1 - p)),    u a fixed uniform number of the doc_id,

of which the smallest are taken until the source's remaining words are used up.
Words that are left because the next document is too large go, in `fill` further
rounds of the same ranking, to documents that still fit.

Scale. The text is read once, to count words. A source may hold any share of the
rows: ranks are cut into 65,536 bins, the words of each bin are summed with
partial aggregation, a running sum over bins finds the one bin in which a
source's words run out, and only that bin's documents are put in order. Nothing
is sorted by source as a whole. Per-source tables are broadcast after being
counted, and joined by shuffle when they are large.

Defined results: a null text has 0 words; documents of 0 words are never taken;
a null source is a source of its own; a null doc_id draws the number of the empty
string; repeated rows draw the same number, and as they cannot be told apart any
of them may be the one that is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm.common import materialize, maybe_broadcast, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 3
BINS = 65_536
FILL = 2


def uniform(key: Column) -> Column:
    """A number in (0, 1), fixed by key: 52 bits of its MD5."""
    hexes = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _water_level(rows: DataFrame, keys: list[str], weight: str, cap: str, total: Column, order: list[str]) -> DataFrame:
    """rows with `level`: the x for which the sum of least(weight * x, cap) over the rows of a key is total."""
    rows = rows.withColumn("ratio", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("ratio", *order)
    before = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing))
    at = F.when(weights > 0, (total - before).cast("double") / weights)
    rows = rows.withColumn("at", at)
    fits = F.when(F.col("at") <= F.col("ratio"), F.col("at"))
    return rows.withColumn("level", F.max(fits).over(Window.partitionBy(*keys))).drop("ratio", "at")


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))
    per = per.withColumn("cap", (F.col("source_size") * max_repeat).cast("long"))
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = _water_level(per, [], "weight", "cap", F.col("total"), ["source"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return per.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _expected(sizes: DataFrame, of: DataFrame, max_repeat: int) -> DataFrame:
    """(x_source, x_stratum, certain, p, budget): budget is a source's words beyond its certain copies."""
    strata = sizes.groupBy("source", "stratum").agg(F.sum("size").cast("long").alias("words"))
    of = of.select(F.col("source").alias("t_source"), "target")
    strata = strata.join(maybe_broadcast(of), _same("source", "t_source")).drop("t_source")
    strata = strata.withColumn("pull", F.col("words") * (F.col("stratum") + 1))
    strata = strata.withColumn("cap", F.col("words") * max_repeat)
    strata = _water_level(strata, ["source"], "pull", "cap", F.col("target"), ["stratum"])
    copies = F.least(F.lit(float(max_repeat)), F.col("level") * (F.col("stratum") + 1))
    copies = F.when(F.col("words") > 0, F.coalesce(copies, F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    strata = strata.withColumn("copies", copies).withColumn("certain", F.floor("copies").cast("long"))
    strata = strata.withColumn("p", F.col("copies") - F.col("certain"))
    sure = F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    return strata.select(
        F.col("source").alias("x_source"), F.col("stratum").alias("x_stratum"), "certain", "p",
        (F.col("target") - sure).alias("budget"),
    )


def _take(rows: DataFrame) -> DataFrame:
    """rows (.., source, size, rank, budget, extra, open): extra becomes 1 for open rows in order of rank while budget lasts."""
    rows = rows.withColumn("bin", F.when(F.col("open"), F.floor(F.col("rank") / (F.col("rank") + 1) * BINS).cast("int")))
    bins = rows.where("open").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    bins = bins.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
    edge = bins.groupBy(F.col("source").alias("e_source")).agg(
        F.min("bin").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("used")
    )
    rows = rows.join(maybe_broadcast(edge), _same("source", "e_source"), "left").drop("e_source")
    inside = F.col("open") & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")))
    at_edge = F.coalesce(F.col("open") & (F.col("bin") == F.col("edge")), F.lit(False))
    sure = rows.where(~at_edge).withColumn("extra", F.when(inside, 1).otherwise(F.col("extra")))
    w = Window.partitionBy("source").orderBy("rank", "doc_id", "size", *(["row"] if "row" in rows.columns else []))
    running = F.col("used") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = rows.where(at_edge).withColumn("fits", running <= F.col("budget"))
    last = last.withColumn("extra", F.when(F.col("fits"), 1).otherwise(F.col("extra"))).drop("fits")
    return sure.unionByName(last).drop("bin", "edge", "used")


def copies(sizes: DataFrame, max_repeat: int = MAX_REPEAT, fill: int = FILL) -> DataFrame:
    """sizes (doc_id, source, size, ...) with source_size, target and copies, the whole copies the mix takes.

    sizes is read several times and should be a stored table. A column row, where there is
    one, tells repeated rows apart.
    """
    of = materialize(targets(sizes, max_repeat), "mix-targets")
    rows = sizes.withColumn("stratum", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    expected = materialize(_expected(rows, of, max_repeat), "mix-strata")
    here = _same("source", "x_source") & (F.col("stratum") == F.col("x_stratum"))
    rows = rows.join(maybe_broadcast(expected), here).drop("x_source", "x_stratum", "stratum")
    u = uniform(F.col("doc_id"))
    odds = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.withColumn("rank", odds).withColumn("extra", F.lit(0))
    rows = rows.withColumn("open", F.col("rank").isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col("budget")))
    rows = materialize(_take(rows), "mix-0")
    for k in range(1, fill + 1):
        used = rows.groupBy(F.col("source").alias("u_source")).agg(F.sum(F.col("extra") * F.col("size")).alias("spent"))
        rows = rows.join(maybe_broadcast(used), _same("source", "u_source")).drop("u_source", "open")
        rows = rows.withColumn("left", F.col("budget") - F.col("spent")).drop("spent")
        free = F.col("rank").isNotNull() & (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        rows = rows.withColumn("open", free).withColumnRenamed("budget", "whole").withColumnRenamed("left", "budget")
        rows = _take(rows).drop("budget").withColumnRenamed("whole", "budget")
        rows = materialize(rows, f"mix-{k}")
    of = of.withColumnRenamed("source", "t_source")
    rows = rows.join(maybe_broadcast(of), _same("source", "t_source"))
    return rows.select(*sizes.columns, "source_size", "target", (F.col("certain") + F.col("extra")).alias("copies"))


def sizes_of(docs: DataFrame, *names: str) -> DataFrame:
    """(doc_id, source, size) and the named columns of docs; size is the number of words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), *names)


def mix(docs: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    return copies(materialize(sizes_of(docs), "mix-sizes"), max_repeat)


def digest(mixed: DataFrame) -> DataFrame:
    """The columns of the op7 contract."""
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(mix(table(spark, sf_dir, "documents")))


_PASS = """
open{k} AS (SELECT *, {budget} AS b{k}, sum(size) OVER (PARTITION BY source, {ok} ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS run{k}, {ok} AS ok{k} FROM {before}),
take{k} AS (SELECT * REPLACE (CASE WHEN ok{k} AND run{k} <= b{k} THEN 1 ELSE extra END AS extra) FROM open{k}),
"""

ORACLE = (
    r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
         sum(source_size) OVER () AS total FROM per),
lined AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         CAST(total - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM weighed),
aims AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT max(lev) FROM lined WHERE lev <= ratio)) AS target FROM lined),
strata AS (
  SELECT d.source, CAST(floor(log2(size + 1)) AS INTEGER) AS stratum, CAST(sum(size) AS BIGINT) AS words, max(target) AS target
  FROM docs d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source GROUP BY ALL),
pulled AS (
  SELECT *, words * (stratum + 1) AS pull, 3 * words AS cap,
         CASE WHEN words > 0 THEN CAST(3 * words AS DOUBLE) / (words * (stratum + 1)) ELSE 0.0 END AS ratio FROM strata),
levels AS (
  SELECT *, CASE WHEN sum(pull) OVER f > 0 THEN (target - coalesce(sum(cap) OVER p, 0)) / CAST(sum(pull) OVER f AS DOUBLE) END AS lev
  FROM pulled WINDOW p AS (PARTITION BY source ORDER BY ratio, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     f AS (PARTITION BY source ORDER BY ratio, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
wanted AS (
  SELECT *, CASE WHEN words > 0 THEN least(3.0::DOUBLE, coalesce(max(CASE WHEN lev <= ratio THEN lev END) OVER (PARTITION BY source) * (stratum + 1), 3.0::DOUBLE)) ELSE 0.0 END AS copies
  FROM levels),
plan AS (
  SELECT source, stratum, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS p,
         target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS budget FROM wanted),
drawn AS (
  SELECT d.doc_id, d.source, d.size, certain, p, budget, 0 AS extra,
         (CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN plan x ON d.source IS NOT DISTINCT FROM x.source AND CAST(floor(log2(d.size + 1)) AS INTEGER) = x.stratum),
ranked AS (SELECT * EXCLUDE (u), CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM drawn),
"""
    + _PASS.format(k=0, before="ranked", budget="budget", ok="(rank IS NOT NULL AND size > 0 AND size <= budget)")
    + "".join(
        f"left{k} AS (SELECT *, budget - sum(extra * size) OVER (PARTITION BY source) AS l{k} FROM take{k - 1}),"
        + _PASS.format(
            k=k, before=f"left{k}", budget=f"l{k}", ok=f"(rank IS NOT NULL AND extra = 0 AND size > 0 AND size <= l{k})"
        )
        for k in range(1, FILL + 1)
    )
    + f"""
final AS (SELECT doc_id, source, size, certain + extra AS copies FROM take{FILL})
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken
FROM final f JOIN aims a ON f.source IS NOT DISTINCT FROM a.source
"""
)
