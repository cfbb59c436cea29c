"""Logs to files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.log import EventLog, ObjectLog
from caseweave.operators import access
from caseweave.sources.readers import XES_KEYS


def write_log(log: EventLog, folder: str) -> dict:
    """events.parquet, hashed by case and sorted within files, cases.parquet, and meta.json with counts and types."""
    spark = log.df.sparkSession
    log.events.repartition("case_id").sortWithinPartitions("case_id", "timestamp", "seq").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/events.parquet")
    stored = EventLog(spark.read.parquet(f"{folder}/events.parquet"))
    access.cases(stored).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/cases.parquet")
    row = stored.df.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("case_id").alias("cases"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    meta = {"log_model": "case_centric", "events": row["events"], "cases": row["cases"], "min_timestamp": str(row["lo"]), "max_timestamp": str(row["hi"]), "schema": dict(stored.df.dtypes)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta.json")
    return meta


def write_object_log(log: ObjectLog, folder: str) -> None:
    for name in ("events", "objects", "relations", "o2o"):
        getattr(log, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def write_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """One header per file; nested columns as JSON."""
    nested = lambda t: t.startswith(("struct", "array", "map"))
    out = df.select(*(F.to_json(f"`{c}`").alias(c) if nested(t) else F.col(f"`{c}`") for c, t in df.dtypes))
    (out if limit is None else out.limit(limit)).write.mode("overwrite").csv(path, header=True)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Spark types and the XES tags that carry them.
_XES_TAGS = {"string": "string", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}


def xes_traces(log: EventLog) -> DataFrame:
    """(case_id, trace): each case as a XES trace element.

    Columns of text, numbers, truth values and times become attributes with the tag of
    their type, roles under their standard keys; nulls have none. A column case:<key> is
    an attribute of the trace, with the value of the case's first event. Other types are left out.
    """
    keys = {column: key for key, column in XES_KEYS.items()}
    text = lambda kind, key, value: F.concat(F.lit(f'<{kind} key="'), _escaped(F.lit(key)), F.lit('" value="'), _escaped(value), F.lit('"/>'))
    kinds = {c: "float" if t.startswith("decimal") else _XES_TAGS.get(t) for c, t in log.events.dtypes}

    def tag(column: str, key: str) -> Column:
        value = F.col(f"`{column}`")
        shown = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")) if kinds[column] == "date" else value.cast("string")
        return F.coalesce(text(kinds[column], key, shown), F.lit(""))

    written = [c for c, kind in kinds.items() if kind and c not in ("case_id", "activity", "timestamp", "seq")]
    time = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
    known = [text("string", "concept:name", F.coalesce("activity", F.lit(""))), text("date", "time:timestamp", time)]
    event = F.concat(F.lit("<event>"), *known, *(tag(c, keys.get(c, c)) for c in written if not c.startswith("case:")), F.lit("</event>"))
    case = F.concat(F.lit(""), *(tag(c, c.removeprefix("case:")) for c in written if c.startswith("case:") and c != "case:concept:name"))
    rows = log.events.select("case_id", F.struct("timestamp", "seq", event.alias("xml")).alias("e"), case.alias("of"))
    rows = rows.groupBy("case_id").agg(F.array_sort(F.collect_list("e")).alias("es"), F.min_by("of", F.struct("e.timestamp", "e.seq")).alias("of"))
    name = text("string", "concept:name", F.coalesce("case_id", F.lit("")))
    return rows.select("case_id", F.concat(F.lit("<trace>"), name, "of", F.array_join(F.transform("es", lambda e: e["xml"]), ""), F.lit("</trace>")).alias("trace"))


def write_xes(log: EventLog, path: str) -> None:
    """A XES document as a folder of parts, which in order of their names make one file; traces come in order of case."""
    spark = log.df.sparkSession
    head = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0" xmlns="http://www.xes-standard.org/">')], "k int, case_id string, value string")
    tail = spark.createDataFrame([(2, "", "</log>")], "k int, case_id string, value string")
    body = xes_traces(log).select(F.lit(1).alias("k"), "case_id", F.col("trace").alias("value"))
    head.union(body).union(tail).repartitionByRange("k", "case_id").sortWithinPartitions("k", "case_id").select("value").write.mode("overwrite").text(path)


def bpmn(tree_arcs: DataFrame) -> str:
    """A BPMN document of a process tree given as arcs: tasks, and a pair of gateways for each operator but sequence."""
    from xml.sax.saxutils import quoteattr

    kids: dict[str, list[tuple[int, str, str]]] = {}
    kind: dict[str, str] = {}
    for r in tree_arcs.collect():
        kind[r["source"]] = r["kind"]
        name, _, label = r["target"].partition(":") if r["kind"] != "activity" else ("0.0", "", r["target"])
        kids.setdefault(r["source"], []).append((int(name.rpartition(".")[2]), name, label))
    nodes, flows = ['<startEvent id="start"/>', '<endEvent id="end"/>'], []

    def flow(a: str, b: str) -> None:
        flows.append(f'<sequenceFlow id="f{len(flows)}" sourceRef={quoteattr(a)} targetRef={quoteattr(b)}/>')

    def gateway(name: str, parallel: bool) -> str:
        nodes.append(f'<{"parallelGateway" if parallel else "exclusiveGateway"} id={quoteattr(name)}/>')
        return name

    def build(name: str, label: str, before: str) -> str:
        """Adds a node of the tree after the element `before`; the element it ends in."""
        parts = sorted(kids.get(name, []))
        operator = kind.get(name)
        if not parts and label == "τ":
            return before
        if not parts or operator == "activity":
            task = f"t{name}"
            nodes.append(f"<task id={quoteattr(task)} name={quoteattr(parts[0][2] if parts else label)}/>")
            flow(before, task)
            return task
        if operator == "sequence":
            for _, child, text in parts:
                before = build(child, text, before)
            return before
        split, join = gateway(f"s{name}", operator == "parallel"), gateway(f"j{name}", operator == "parallel")
        flow(before, split)
        if operator == "loop":
            # The body runs from split to join, each redo part back from join to split.
            flow(build(parts[0][1], parts[0][2], split), join)
            for _, child, text in parts[1:]:
                flow(build(child, text, join), split)
        else:
            for _, child, text in parts:
                flow(build(child, text, split), join)
        return join

    if kids:
        flow(build("0", "", "start"), "end")
    return "\n".join(['<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL"><process id="p">', *nodes, *flows, "</process></definitions>"])
