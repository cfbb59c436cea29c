"""Object-centric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import seconds_between
from caseweave.log import ObjectLog
from caseweave.operators.quantiles import described, with_quantiles


def overview(log: ObjectLog) -> DataFrame:
    """Counts of the four tables, of activities and types, and the time span."""
    e = log.events.agg(F.count("*").alias("events"), F.count_distinct("activity").alias("activities"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))
    o = log.objects.agg(F.count("*").alias("objects"), F.count_distinct("type").alias("types"))
    r = log.relations.agg(F.count("*").alias("relations"))
    x = log.o2o.agg(F.count("*").alias("o2o"))
    return e.crossJoin(F.broadcast(o)).crossJoin(F.broadcast(r)).crossJoin(F.broadcast(x))


def object_page(log: ObjectLog, object_type: str | None = None, q: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    rows = log.objects
    if object_type is not None:
        rows = rows.where(F.col("type") == object_type)
    if q:
        rows = rows.where(F.col("oid").cast("string").ilike(f"%{q}%"))
    return rows.orderBy("oid").offset(offset).limit(limit)


def type_counts(log: ObjectLog) -> DataFrame:
    return log.objects.groupBy("type").agg(F.count("*").alias("n"))


def activity_types(log: ObjectLog) -> DataFrame:
    """Distinct events and objects for each activity and object type."""
    return log.relations.groupBy("activity", "type").agg(F.count_distinct("eid").alias("events"), F.count_distinct("oid").alias("objects"))


def _lives(log: ObjectLog) -> DataFrame:
    """(oid, type, start, end, n_events) of each object with events."""
    rows = log.relations.groupBy("oid", "type").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count_distinct("eid").alias("n_events"))
    return rows.withColumn("lifetime_s", seconds_between(F.col("start"), F.col("end")))


def lifecycle(log: ObjectLog) -> DataFrame:
    """Median and mean lifetime, mean events of each object type."""
    lives = _lives(log)
    rows = lives.groupBy("type").agg(
        F.count("*").alias("objects"), F.round(F.avg("lifetime_s"), 6).alias("avg_lifetime_s"), F.round(F.avg("n_events"), 6).alias("avg_events")
    )
    rows = with_quantiles(rows, lives, "lifetime_s", (0.5,), ("type",))
    return rows.select("type", "objects", F.round(F.col("q")[0], 6).alias("median_lifetime_s"), "avg_lifetime_s", "avg_events")


def longest_lived(log: ObjectLog, top: int = 50) -> DataFrame:
    return _lives(log).orderBy(F.desc("lifetime_s"), "oid").limit(top)


#: Classes of objects that one task pairs within an event; more are dealt to several tasks.
_TILE = 512
#: Pairs of objects by event, as a multiple of relations, up to which they are formed as they are.
_PAIRS = 4


def interaction_graph(log: ObjectLog) -> DataFrame:
    """Object pairs with a common event, counted by unordered pair of types; an object is an oid with its type.

    Pairs are formed event by event where that makes few of them, which is counted first, and no event has
    very many. Else objects of one type with the same events are one class with a size, so an event with
    very many objects that occur nowhere else pairs a few classes. Classes are told by the
    number of their events and 128 bits of their hashes. An event of many classes is cut
    into tiles of its pairs.
    """
    r = log.relations.where("eid IS NOT NULL AND oid IS NOT NULL AND type IS NOT NULL").select("eid", "oid", "type").distinct()
    per = r.groupBy("eid").agg(F.count("*").alias("n")).select("n", (F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    size = per.agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.max("n").alias("most")).first()
    if (size["most"] or 0) <= _TILE and (size["pairs"] or 0) <= _PAIRS * (size["n"] or 0):
        a, b = (r.select("eid", F.col("oid").alias(f"oid_{x}"), F.col("type").alias(f"type_{x}")) for x in "ab")
        both = a.join(b, "eid").where(F.struct("type_a", "oid_a") < F.struct("type_b", "oid_b"))
        pairs = both.select("oid_a", "oid_b", "type_a", "type_b").distinct()
        return pairs.groupBy(F.col("type_a").alias("source"), F.col("type_b").alias("target")).agg(F.count("*").alias("pairs"))
    return _interaction_of_classes(r)


def _interaction_of_classes(r: DataFrame) -> DataFrame:
    """interaction_graph of distinct (eid, oid, type) by classes of objects with the same events."""
    sets = r.groupBy("oid", "type").agg(F.bit_xor(F.xxhash64("eid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "eid")).alias("y"), F.count("*").alias("m"))
    classes = sets.groupBy("type", "x", "y", "m").agg(F.min("oid").alias("oid"), F.count("*").alias("n")).select("oid", "type", "n")
    met = r.join(classes, ["oid", "type"])
    tiles = met.groupBy("eid").agg(F.ceil(F.count("*") / _TILE).cast("int").alias("tiles"))
    met = met.join(tiles, "eid")
    side = lambda x, tile: met.select("eid", tile.alias("tile"), *(F.col(c).alias(f"{c}_{x}") for c in ("oid", "type", "n")))
    a = side("a", F.pmod(F.xxhash64("oid", "type"), F.col("tiles")).cast("int"))
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = a.join(b, ["eid", "tile"]).where(F.struct("oid_a", "type_a") < F.struct("oid_b", "type_b"))
    apart = both.select("oid_a", "type_a", "n_a", "oid_b", "type_b", "n_b").distinct().select("type_a", "type_b", (F.col("n_a") * F.col("n_b")).alias("pairs"))
    within = classes.where("n > 1").select(F.col("type").alias("type_a"), F.col("type").alias("type_b"), F.expr("n * (n - 1) div 2").alias("pairs"))
    rows = apart.union(within).groupBy(F.least("type_a", "type_b").alias("source"), F.greatest("type_a", "type_b").alias("target"))
    return rows.agg(F.sum("pairs").alias("pairs"))


def interaction_degree(log: ObjectLog) -> DataFrame:
    """Mean number of directly linked objects (o2o, either way) by type, over linked objects."""
    both = log.o2o.select("oid", "oid_2").union(log.o2o.select("oid_2", "oid")).where("oid <> oid_2")
    degree = both.groupBy("oid").agg(F.count_distinct("oid_2").alias("degree"))
    return degree.join(log.objects.select("oid", "type"), "oid").groupBy("type").agg(F.round(F.avg("degree"), 6).alias("avg_interacting"))


def ocdfg_edges(log: ObjectLog) -> DataFrame:
    """Directly-follows edges per object type: unique objects, event couples, all occurrences, mean and median seconds."""
    w = Window.partitionBy("type", "oid").orderBy("timestamp", "eid")
    r = log.relations.select("eid", "oid", "type", "activity", "timestamp").distinct()
    e = r.select(
        "type", "oid", "eid", F.col("activity").alias("source"),
        F.lead("activity").over(w).alias("target"), F.lead("eid").over(w).alias("next_eid"),
        seconds_between(F.col("timestamp"), F.lead("timestamp").over(w)).alias("seconds"),
    ).where(F.col("next_eid").isNotNull())
    # Each distinct count by an aggregation of its own key first, so nothing is expanded.
    edge = ["type", "source", "target"]
    objects = e.groupBy(*edge, "oid").agg(F.lit(1)).groupBy(*edge).agg(F.count("*").alias("unique_objects"))
    couples = e.groupBy(*edge, "eid", "next_eid").agg(F.lit(1)).groupBy(*edge).agg(F.count("*").alias("event_couples"))
    rows = described(e, "seconds", (0.5,), edge)
    rows = rows.select(*edge, F.col("n").alias("total_objects"), F.round("mean", 6).alias("mean_s"), F.round(F.col("q")[0], 6).alias("median_s"))
    return rows.join(objects, edge).join(couples, edge)


def ocdfg_endpoints(log: ObjectLog) -> DataFrame:
    """(type, activity, starts, ends): objects that begin or end with an activity."""
    order = F.struct("timestamp", "eid")
    per = log.relations.groupBy("type", "oid").agg(F.min_by("activity", order).alias("first"), F.max_by("activity", order).alias("last"))
    both = per.select("type", F.explode(F.array(F.struct(F.col("first").alias("activity"), F.lit(1).alias("s")), F.struct(F.col("last").alias("activity"), F.lit(0).alias("s")))).alias("x"))
    return both.groupBy("type", "x.activity").agg(F.sum("x.s").alias("starts"), F.sum(1 - F.col("x.s")).alias("ends"))


GRAPHS = ("interaction", "descendants", "inheritance", "cobirth", "codeath")


def object_graph(log: ObjectLog, kind: str) -> DataFrame:
    """Object pairs of a relation, counted by ordered pair of types (unordered for interaction, cobirth, codeath).

    For objects of a common event: descendants - b starts at it and a started before;
    inheritance - a ends and b starts there; cobirth - both start there; codeath -
    both end there. An object is an oid with its type.

    An object starts and ends once, so a pair is in such a relation at one event only:
    the pairs are a sum over events of products of counts, and none is formed.
    """
    if kind == "interaction":
        return interaction_graph(log)
    known = "eid IS NOT NULL AND oid IS NOT NULL AND type IS NOT NULL"
    r = log.relations.where(known)
    order = F.struct("timestamp", "eid")
    ends = {"born": F.min(order).alias("born"), "dead": F.max(order).alias("dead")}
    ends = [ends[c] for c in {"descendants": ("born",), "cobirth": ("born",), "codeath": ("dead",)}.get(kind, ("born", "dead"))]
    life = (log.relations if log.repeated is None else log.repeated).where(known).groupBy("oid", "type").agg(*ends)
    life = life.select("oid", "type", *(F.col(f"{c}.eid").alias(c) if c in life.columns else F.lit(None).cast(r.schema["eid"].dataType).alias(c) for c in ("born", "dead")))
    if kind == "descendants":
        return _descendants(r.select("eid", "oid", "type").distinct(), life.select(F.col("born").alias("eid"), "type"))
    counted = lambda df, eid, what: df.select(F.col(eid).alias("eid"), "type", F.lit(what).alias("what"))
    marks = [counted(life, "born", "born"), counted(life, "dead", "dead"), counted(life.where("born = dead"), "born", "both")]
    wanted = {"inheritance": marks, "cobirth": marks[:1], "codeath": marks[1:2]}[kind]
    rows = wanted[0]
    for more in wanted[1:]:
        rows = rows.unionByName(more)
    per = rows.groupBy("eid", "type").agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("born", "dead", "both")))
    # At most as many rows an event as there are types.
    a = per.select("eid", *(F.col(c).alias(f"{c}_a") for c in ("type", "born", "dead", "both")))
    b = per.select("eid", *(F.col(c).alias(f"{c}_b") for c in ("type", "born", "dead", "both")))
    same = F.col("type_a") == F.col("type_b")
    if kind == "inheritance":
        n = F.col("dead_a") * F.col("born_b") - F.when(same, F.col("both_a")).otherwise(0)
    else:
        c = "born" if kind == "cobirth" else "dead"
        n = F.when(same, F.expr(f"{c}_a * ({c}_a - 1) div 2")).when(F.col("type_a") < F.col("type_b"), F.col(f"{c}_a") * F.col(f"{c}_b")).otherwise(0)
    pairs = a.join(b, "eid").select("type_a", "type_b", n.cast("bigint").alias("n")).where("n > 0")
    return pairs.groupBy(F.col("type_a").alias("source"), F.col("type_b").alias("target")).agg(F.sum("n").alias("pairs"))


def _descendants(r: DataFrame, born: DataFrame) -> DataFrame:
    """Pairs of object_graph of distinct (eid, oid, type) and the (eid, type) of births: an event's objects times its births, less its births times themselves.

    Births are dealt by event alone, so a log that is dealt so meets them where it is.
    """
    born = born.repartition("eid").groupBy("eid", F.col("type").alias("type_b")).agg(F.count("*").alias("n"))
    others = born.select("eid", F.col("type_b").alias("type_a"), F.col("n").alias("m"))
    every = r.select("eid", F.col("type").alias("type_a")).join(born, "eid").groupBy("type_a", "type_b").agg(F.sum("n").alias("n"))
    both = others.join(born, "eid").groupBy("type_a", "type_b").agg(F.sum(F.col("m") * F.col("n")).alias("own"))
    pairs = every.join(both, ["type_a", "type_b"], "left").withColumn("pairs", F.col("n") - F.coalesce("own", F.lit(0)))
    return pairs.where("pairs > 0").select(F.col("type_a").alias("source"), F.col("type_b").alias("target"), "pairs")


def variable_arcs(log: ObjectLog) -> DataFrame:
    """(activity, type, variable): whether an activity's events hold several, or no, objects of a type at times."""
    per = log.relations.groupBy("activity", "type", "eid").agg(F.count_distinct("oid").alias("k"))
    per = per.groupBy("activity", "type").agg(F.count("*").alias("with"), F.max("k").alias("most"))
    n = log.events.groupBy("activity").agg(F.count_distinct("eid").alias("n"))
    return per.join(n, "activity").select("activity", "type", ((F.col("most") > 1) | (F.col("with") < F.col("n"))).alias("variable"))
