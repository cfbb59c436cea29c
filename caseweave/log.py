"""The two log models: case-centric event logs and object-centric logs.

Both wrap lazy DataFrames. Derived tables (cases, traces, variants, edges) are
DataFrames too; Spark plans them together with whatever is built on top.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from caseweave.functions import seconds_between

#: Roles a log must have, and those it may have.
REQUIRED = ("case_id", "activity", "timestamp")
OPTIONAL = ("end_timestamp", "resource", "cost", "role", "lifecycle")
ARROW = "→"


class WrongModel(ValueError):
    """An operator of one log model was asked for on the other."""


@dataclass(frozen=True)
class EventLog:
    """One row per event; df has case_id, activity, timestamp, and seq, which orders equal timestamps.

    `view` is a committed filter: `events` shows matching rows, `raw` all of them.
    """

    df: DataFrame
    view: Column | None = None

    @classmethod
    def from_table(cls, df: DataFrame, case: Column | str, activity: str, timestamp: str, seq: str | None = None, **roles: str) -> EventLog:
        """A log from any table; further roles by keyword, other columns kept. Rows without a timestamp go."""
        named = {"activity": activity, "timestamp": timestamp, **roles}
        case = F.col(case) if isinstance(case, str) else case
        used = {*named.values(), seq} - {None}
        order = F.col(seq) if seq else F.xxhash64(*df.columns)
        rest = [F.col(c) for c in df.columns if c not in used and c not in {*named, "case_id", "seq"}]
        columns = [case.cast("string").alias("case_id"), *(F.col(c).alias(r) for r, c in named.items()), order.alias("seq"), *rest]
        return cls(df.select(*columns).where(F.col("timestamp").isNotNull()))

    @property
    def raw(self) -> DataFrame:
        return self.df

    @property
    def events(self) -> DataFrame:
        return self.df if self.view is None else self.df.where(self.view)

    def filtered(self, view: Column | None) -> EventLog:
        """The same log under another committed filter; it replaces the present one."""
        return replace(self, view=view)

    @property
    def in_case(self) -> WindowSpec:
        """The one window all per-case operators use, so Spark sorts once."""
        return Window.partitionBy("case_id").orderBy("timestamp", "seq")

    def sequenced(self) -> DataFrame:
        """Events with pos (from 1), n (events of the case), next and previous activity and time."""
        w, whole = self.in_case, Window.partitionBy("case_id")
        return self.events.select(
            "*",
            F.row_number().over(w).alias("pos"),
            F.count("*").over(whole).alias("n"),
            F.lead("activity").over(w).alias("next_activity"),
            F.lead("timestamp").over(w).alias("next_timestamp"),
            F.lag("activity").over(w).alias("prev_activity"),
        )

    def edges(self) -> DataFrame:
        """Directly-follows pairs: case_id, source, target, seconds."""
        w = self.in_case
        pairs = self.events.select(
            "case_id",
            F.col("activity").alias("source"),
            F.lead("activity").over(w).alias("target"),
            seconds_between(F.col("timestamp"), F.lead("timestamp").over(w)).alias("seconds"),
            F.lead("seq").over(w).isNotNull().alias("has_next"),
        )
        return pairs.where("has_next").drop("has_next")

    def traces(self) -> DataFrame:
        """One row per case: case_id, trace (array of activities), case_start, case_end, n_events."""
        step = F.struct("timestamp", "seq", "activity")
        rows = self.events.groupBy("case_id").agg(
            F.transform(F.array_sort(F.collect_list(step)), lambda s: s["activity"]).alias("trace"),
            F.min("timestamp").alias("case_start"),
            F.max("timestamp").alias("case_end"),
            F.count("*").alias("n_events"),
        )
        return rows.withColumn("duration_s", seconds_between(F.col("case_start"), F.col("case_end")))

    def variants(self) -> DataFrame:
        """One row per distinct trace: trace, n_cases."""
        return self.traces().groupBy("trace").agg(F.count("*").alias("n_cases"))


@dataclass(frozen=True)
class ObjectLog:
    """Object-centric log: events, objects, relations (event, object, type, activity, time) and object-to-object links.

    Columns: events (eid, activity, timestamp), objects (oid, type), relations
    (eid, oid, type, activity, timestamp, qualifier), o2o (oid, oid_2, qualifier).
    repeated, if given, has the rows of relations before repeated ones were dropped, for
    aggregates that these don't change and that shall not wait for their removal.
    """

    events: DataFrame
    objects: DataFrame
    relations: DataFrame
    o2o: DataFrame
    repeated: DataFrame | None = None

    def flatten(self, object_type: str) -> EventLog:
        """The case-centric log of one object type: each object is a case."""
        rows = self.relations.where(F.col("type") == object_type)
        return EventLog(rows.select(F.col("oid").alias("case_id"), "activity", "timestamp", F.col("eid").alias("seq")))


def event_log(log: object) -> EventLog:
    if not isinstance(log, EventLog):
        raise WrongModel("this operator needs a case-centric log")
    return log


def object_log(log: object) -> ObjectLog:
    if not isinstance(log, ObjectLog):
        raise WrongModel("this operator needs an object-centric log")
    return log
