"""Event logs and object-centric logs from files, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.log import EventLog, ObjectLog
from caseweave.sources import roles

#: XES attribute keys and the columns they become.
XES_KEYS = {
    "concept:name": "activity",
    "time:timestamp": "timestamp",
    "org:resource": "resource",
    "org:role": "role",
    "lifecycle:transition": "lifecycle",
    "cost:total": "cost",
}
XES_TYPES = ("string", "date", "int", "float", "boolean", "id")
JSON_KEYS = ("events", "log", "data", "records", "items")


class EmptyLog(ValueError):
    pass


def detect_format(name: str) -> str:
    """Format by file name: parquet, csv, xes, xml, json, jsonl, or ocel-json, ocel-xml, ocel-sqlite."""
    name = PurePosixPath(name).name.lower().removesuffix(".gz")
    for ending, kind in (
        (".jsonocel", "ocel-json"), (".ocel.json", "ocel-json"), (".xmlocel", "ocel-xml"), (".ocel.xml", "ocel-xml"), (".sqlite", "ocel-sqlite"),
        (".parquet", "parquet"), (".csv", "csv"), (".tsv", "csv"), (".xes", "xes"), (".xml", "xml"), (".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "json"),
    ):
        if name.endswith(ending):
            return kind
    raise ValueError(f"unknown format: {name}")


def sniff(spark: SparkSession, path: str) -> str:
    """detect_format, then a look at the first bytes: XES inside .xml, OCEL inside .json or .xml."""
    kind = detect_format(path)
    if kind in ("xml", "json"):
        # Cut at a frequent character, so that only the first pieces are read, however long the file and its lines.
        end = ">" if kind == "xml" else ","
        text = end.join(r["value"] for r in spark.read.option("lineSep", end).text(path).limit(300).collect())
        if kind == "xml":
            return "xes" if "<log" in text and ("xes" in text or "<trace" in text) else "ocel-xml" if "<object-types" in text or "ocel" in text[:500] else kind
        return "ocel-json" if '"ocel:events"' in text or '"objectTypes"' in text else kind
    return kind


def as_time(column: Column) -> Column:
    """A time without zone from text or a timestamp; offsets are normalised to UTC, unparseable text is null."""
    text = column.cast("string")
    zoned = F.try_to_timestamp(text)
    naive = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(Z|[+-]\d{2}:?\d{2})$", "")
    offset = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    seconds = F.when(offset == "", 0).otherwise(
        (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, -2, 2).try_cast("int") * 60) * F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    )
    has_clock = text.contains(":")
    plain = naive.try_cast("timestamp_ntz")
    return F.when(zoned.isNull() & plain.isNull(), None).when(has_clock, plain - F.make_dt_interval(secs=seconds)).otherwise(text.try_cast("timestamp_ntz"))


def coerce(df: DataFrame, text_only: tuple[str, ...] = ()) -> DataFrame:
    """Text columns of which every value is a number become numbers; one aggregate decides."""
    text = [c for c, t in df.dtypes if t == "string" and c not in text_only]
    if not text:
        return df
    bad = df.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != "") & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"b{k}") for k, c in enumerate(text)), *(F.count(F.nullif(F.col(f"`{c}`"), F.lit(""))).alias(f"n{k}") for k, c in enumerate(text))).first()
    numeric = {c for k, c in enumerate(text) if bad[f"n{k}"] and not bad[f"b{k}"]}
    return df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) if c in numeric else F.col(f"`{c}`").alias(c) for c in df.columns))


#: Roles that stay text whatever their values.
_TEXT_ROLES = ("case_id", "activity", "timestamp", "end_timestamp", "resource", "role", "lifecycle")


def to_log(df: DataFrame, overrides: Mapping[str, str] | None = None, checked: bool = True, typed: bool = False) -> EventLog:
    """A table as an event log: roles resolved, times normalised, rows without a time dropped, order kept in seq.

    With typed, text columns other than roles of names and times become numbers where all their values are.
    """
    if checked and df.isEmpty():
        raise EmptyLog("no events")
    names = roles.dedupe_case_insensitive(df.columns)
    df = df.toDF(*(names[c] for c in df.columns))
    df = roles.apply(df, roles.resolve(df, overrides))
    df = coerce(df, _TEXT_ROLES) if typed else df
    df = df.withColumn("timestamp", as_time(F.col("timestamp")))
    if "end_timestamp" in df.columns:
        df = df.withColumn("end_timestamp", as_time(F.col("end_timestamp")))
    df = df.withColumn("case_id", F.col("case_id").cast("string")).withColumn("activity", F.col("activity").cast("string"))
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.monotonically_increasing_id())
    return EventLog(df.where(F.col("timestamp").isNotNull()))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; an empty field is the empty string."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=False)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def _attribute() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))


def _attributes(prefix: str = "") -> Column:
    """map from key to text over all typed attribute tags; the first of a key wins."""
    tags = [F.coalesce(F.col(f"{prefix}{t}"), F.array().cast(_attribute())) for t in XES_TYPES]
    pairs = F.concat(*tags)
    keys = F.array_distinct(F.transform(pairs, lambda a: a["_key"]))
    first = lambda k: F.element_at(F.filter(pairs, lambda a: a["_key"] == k), 1)["_value"]
    return F.map_from_arrays(keys, F.transform(keys, first))


def _typed(value: Column, tags: set[str]) -> Column:
    """An attribute's text as the type its tags name: whole number, number, truth value or time; else text."""
    if tags == {"int"}:
        return value.try_cast("bigint")
    if tags <= {"int", "float"}:
        return value.try_cast("double")
    if tags == {"boolean"}:
        return value.try_cast("boolean")
    return as_time(value) if tags == {"date"} else value


def _xes_traces(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Trace elements of XES files, or of the parts of one document, each parsed alone.

    Text is cut where traces close, so a file may be split anywhere, and a part needs no root. A comment that itself
    closes a trace would be cut too: files with one are read whole, by Spark's reader of documents.
    """
    pieces = spark.read.option("lineSep", "</trace").text(path)
    plain = F.regexp_replace(F.regexp_replace("value", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", ""), r"<trace\s*/>", "")
    pieces = pieces.select(plain.alias("value"))
    if not pieces.where(F.col("value").contains("<!--") | F.col("value").contains("<![CDATA[")).isEmpty():
        return spark.read.format("xml").option("rowTag", "trace").schema(schema).load(path)
    found = pieces.select(F.regexp_extract("value", r"(?s)<trace[\s>].*", 0).alias("value")).where("value <> ''")
    return found.select(F.from_xml(F.concat("value", F.lit("</trace>")), schema).alias("x")).select("x.*")


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """One row per event: case_id, the known keys by role, and every other key of the log as a column.

    Trace attributes are copied to each event as case:<key>. Keys and their tags are
    found by one aggregate over the file. A key that only integer, float, boolean or date
    tags carry has that type, null where a value is not of it (integer and float together
    are floats); keys of other or several tags, and roles of names and times, are text.
    """
    event = T.StructType([T.StructField(t, _attribute()) for t in XES_TYPES])
    schema = T.StructType([*event.fields, T.StructField("event", T.ArrayType(event))])
    traces = _xes_traces(spark, path, schema)
    none = F.array().cast("array<struct<k:string,tag:string>>")
    carried = lambda row, prefix: F.concat(*(F.coalesce(F.transform(row(t), lambda a: F.struct(F.concat(F.lit(prefix), a["_key"]).alias("k"), F.lit(t).alias("tag"))), none) for t in XES_TYPES))  # noqa: B023, E731
    of_events = F.flatten(F.coalesce(F.transform("event", lambda e: carried(lambda t: e[t], "")), F.array().cast("array<array<struct<k:string,tag:string>>>")))
    found = traces.select(F.explode(F.array_distinct(F.concat(carried(F.col, "case:"), of_events))).alias("x")).distinct()
    tags: dict[str, set[str]] = {}
    for r in found.where("x.k IS NOT NULL").collect():
        tags.setdefault(r["x"]["k"], set()).add(r["x"]["tag"])
    traces = traces.select(_attributes().alias("trace"), "event")
    # Outer, as the filter that Spark infers from an inner explode would parse every trace twice.
    rows = traces.select("trace", F.posexplode_outer("event").alias("pos", "event")).where("pos IS NOT NULL").select("trace", "pos", _attributes("event.").alias("of"))
    columns = [F.try_element_at("trace", F.lit("concept:name")).alias("case_id")]
    for k in sorted(tags):
        if k.startswith("case:") and k != "case:concept:name":
            columns.append(_typed(F.try_element_at("trace", F.lit(k.removeprefix("case:"))), tags[k]).alias(k))
        elif not k.startswith("case:"):
            name, value = XES_KEYS.get(k, k), F.try_element_at("of", F.lit(k))
            columns.append((value if name in _TEXT_ROLES else _typed(value, tags[k])).alias(name))
    return rows.select(*columns, F.col("pos").alias("seq"))


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Events of generic XML: attributes and leaf children as text columns, a child wins over an attribute."""
    df = spark.read.format("xml").option("rowTag", row_tag or pick_event_element(spark, path)).option("attributePrefix", "@").option("inferSchema", False).load(path)
    plain = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    children = {f.name for f in plain if not f.name.startswith("@")}
    out = [F.coalesce(F.col(f"`{c}`"), F.col(f"`@{c}`")).alias(c) if f"@{c}" in df.columns else F.col(f"`{c}`") for c in children]
    out += [F.col(f"`{f.name}`").alias(f.name[1:]) for f in plain if f.name.startswith("@") and f.name[1:] not in children]
    return df.select(*sorted(out, key=str))


def pick_event_element(spark: SparkSession, path: str) -> str:
    """The most frequent element that has children or attributes, counted over the whole file; of equal ones the first by name."""
    # Pieces end where a tag opens: one is a tag with what follows it, so an element with a child leaves only space after it.
    pieces = spark.read.option("lineSep", "<").text(path).select("value")
    plain = pieces.select(F.regexp_extract("value", r"^([A-Za-z_][\w.:-]*)>\s*$", 1).alias("name"))
    given = pieces.select(F.regexp_extract("value", r"^([A-Za-z_][\w.:-]*)\s[^>]*>", 1).alias("name"))
    names = plain.union(given).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").first()
    return names["name"]


def read_json(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Events of a JSON document: the top-level array, a named or a usual key, or its only array; atoms as text."""
    df = spark.read.option("multiLine", True).json(path)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    pick = key or next((k for k in JSON_KEYS if k in arrays), arrays[0] if arrays else None)
    if pick:
        df = df.select(F.explode(f"`{pick}`").alias("e")).select("e.*")
    atoms = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in atoms))


def probe(df: DataFrame, rows: int = 200) -> DataFrame:
    """(field, coverage, samples) over the first rows: how often a field is there, and up to three values."""
    head = df.limit(rows)
    row = head.agg(F.count(F.lit(1)).alias("n"), *(x for k, c in enumerate(df.columns) for x in (F.count(f"`{c}`").alias(f"c{k}"), F.slice(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))), 1, 3).alias(f"s{k}"))))
    parts = F.array(*(F.struct(F.lit(c).alias("field"), (F.col(f"c{k}") / F.greatest(F.col("n"), F.lit(1))).alias("coverage"), F.col(f"s{k}").alias("samples")) for k, c in enumerate(df.columns)))
    return row.select(F.explode(parts).alias("x")).select("x.*")


def read_log(spark: SparkSession, path: str, overrides: Mapping[str, str] | None = None, **options) -> EventLog:
    """Any case-centric file as an event log."""
    kind = sniff(spark, path)
    match kind:
        case "parquet":
            df = spark.read.parquet(path)
        case "csv":
            df = read_csv(spark, path, **options)
        case "xes":
            df = read_xes(spark, path)
        case "xml":
            df = read_xml(spark, path, **options)
        case "json":
            df = read_json(spark, path, **options)
        case "jsonl":
            df = spark.read.json(path)
        case _:
            raise ValueError(f"{kind} is not a case-centric format")
    return to_log(df, overrides, typed=kind != "parquet")


def read_ocel_json(spark: SparkSession, path: str) -> ObjectLog:
    """An object-centric log of the first (maps by id) or second (arrays) JSON layout."""
    raw = spark.read.text(path, wholetext=True)
    keyed = "map<string,struct<`ocel:activity`:string,`ocel:timestamp`:string,`ocel:omap`:array<string>>>"
    things = "map<string,struct<`ocel:type`:string>>"
    old = raw.select(F.from_json("value", f"`ocel:events` {keyed}, `ocel:objects` {things}").alias("j")).select("j.*")
    new = raw.select(
        F.from_json("value", "events array<struct<id:string,type:string,time:string,relationships:array<struct<objectId:string,qualifier:string>>>>, objects array<struct<id:string,type:string,relationships:array<struct<objectId:string,qualifier:string>>>>").alias("j")
    ).select("j.*")
    e1 = old.select(F.explode("ocel:events").alias("eid", "e")).select("eid", F.col("e.`ocel:activity`").alias("activity"), as_time(F.col("e.`ocel:timestamp`")).alias("timestamp"), F.transform("e.`ocel:omap`", lambda o: F.struct(o.alias("oid"), F.lit(None).cast("string").alias("qualifier"))).alias("omap"))
    e2 = new.select(F.explode("events").alias("e")).select(F.col("e.id").alias("eid"), F.col("e.type").alias("activity"), as_time(F.col("e.time")).alias("timestamp"), F.transform("e.relationships", lambda r: F.struct(r["objectId"].alias("oid"), r["qualifier"].alias("qualifier"))).alias("omap"))
    o1 = old.select(F.explode("ocel:objects").alias("oid", "o")).select("oid", F.col("o.`ocel:type`").alias("type"))
    o2 = new.select(F.explode("objects").alias("o"))
    objects = o1.unionByName(o2.select(F.col("o.id").alias("oid"), F.col("o.type").alias("type")))
    o2o = o2.select(F.col("o.id").alias("oid"), F.explode("o.relationships").alias("r")).select("oid", F.col("r.objectId").alias("oid_2"), F.col("r.qualifier").alias("qualifier"))
    return _object_log(e1.unionByName(e2), objects, o2o)


def read_ocel_xml(spark: SparkSession, path: str) -> ObjectLog:
    """An object-centric log of the second XML layout: event and object elements with relationship children."""
    link = T.ArrayType(T.StructType([T.StructField("_object-id", T.StringType()), T.StructField("_qualifier", T.StringType())]))
    inner = T.StructType([T.StructField("relationship", link), T.StructField("object", link)])
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_type", T.StringType()), T.StructField("_time", T.StringType()), T.StructField("objects", inner)])
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).where(F.col("_id").isNotNull())
    empty = F.array().cast(link)
    both = F.concat(F.coalesce("objects.relationship", empty), F.coalesce("objects.object", empty))
    omap = F.transform(both, lambda r: F.struct(r["_object-id"].alias("oid"), r["_qualifier"].alias("qualifier")))
    events = read("event").select(F.col("_id").alias("eid"), F.col("_type").alias("activity"), as_time(F.col("_time")).alias("timestamp"), omap.alias("omap"))
    things = read("object")
    o2o = things.select(F.col("_id").alias("oid"), F.explode(omap).alias("r")).select("oid", F.col("r.oid").alias("oid_2"), "r.qualifier")
    return _object_log(events, things.select(F.col("_id").alias("oid"), F.col("_type").alias("type")), o2o)


def _object_log(events: DataFrame, objects: DataFrame, o2o: DataFrame) -> ObjectLog:
    """Relations get their object's type by a join on the object."""
    links = events.select("eid", "activity", "timestamp", F.explode("omap").alias("o")).select("eid", "o.oid", "activity", "timestamp", "o.qualifier")
    relations = links.join(objects.select("oid", "type").distinct(), "oid").select("eid", "oid", "type", "activity", "timestamp", "qualifier")
    return ObjectLog(events.drop("omap"), objects, relations, o2o)


def read_object_tables(spark: SparkSession, folder: str) -> ObjectLog:
    """An object-centric log from its four Parquet tables."""
    return ObjectLog(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("events", "objects", "relations", "o2o")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines of text files, numbered from 0 in order of file and place, however the files are split.

    The lines of a split are numbered one after another; the counts of the splits before it are added.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("value", (F.col("before") + F.col("id") - F.col("first")).alias("line"))


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """(constraint, window, value) of a `;` separated constraint table with two header rows; Confidence columns only."""
    text = numbered_lines(spark, path)
    heads = [r["value"].split(";") for r in text.orderBy("line").limit(2).collect()]
    wanted = [k for k, h in enumerate(heads[1]) if h.strip() == "Confidence"]
    parts = text.where(F.col("line") > 1).select("line", F.split("value", ";").alias("v"))
    series = F.array(*(F.struct(F.lit(heads[0][k].strip()).alias("constraint"), F.try_element_at("v", F.lit(k + 1)).try_cast("double").alias("value")) for k in wanted))
    rows = parts.select((F.col("line") - 2).cast("int").alias("window"), F.explode(series).alias("s"))
    return rows.select("s.constraint", "window", "s.value")


def union_logs(logs: list[EventLog]) -> EventLog:
    return EventLog(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (log.df for log in logs)))
