"""Which columns of a table are the case, the activity and the time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known names of each role, in order of preference; compared without case and punctuation.
ALIASES: dict[str, tuple[str, ...]] = {
    "case_id": ("case_id", "case:concept:name", "case", "caseid", "trace_id", "trace", "process_instance"),
    "activity": ("activity", "concept:name", "event", "task", "activity_name", "event_name"),
    "timestamp": ("timestamp", "time:timestamp", "time", "date", "datetime", "start_timestamp", "start_time"),
    "end_timestamp": ("end_timestamp", "end_time", "complete_timestamp", "completed_at"),
    "resource": ("resource", "org:resource", "user", "agent"),
    "cost": ("cost", "cost:total", "amount"),
    "role": ("role", "org:role"),
    "lifecycle": ("lifecycle", "lifecycle:transition", "transition"),
}
#: Parts of a column name that suggest a required role.
HINTS: dict[str, tuple[str, ...]] = {"case_id": ("case", "trace"), "activity": ("activity", "action", "event", "task"), "timestamp": ("timestamp", "time", "date")}
REQUIRED = ("case_id", "activity", "timestamp")
SAMPLE_ROWS = 2_000
PARSE_RATIO = 0.7


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


@dataclass
class Resolution:
    """role -> column, how each was found, and whether somebody should look at it."""

    columns: dict[str, str] = field(default_factory=dict)
    how: dict[str, str] = field(default_factory=dict)

    @property
    def needs_review(self) -> bool:
        return any(self.how.get(r) not in ("override", "exact") for r in REQUIRED)


class UnresolvedRole(ValueError):
    pass


def dedupe_case_insensitive(columns: Iterable[str], keep: Iterable[str] = ()) -> dict[str, str]:
    """column -> unique name: columns that differ by case alone get __src, __src2, ...; names in keep stay."""
    columns, keep = list(columns), set(keep)
    taken = {c.lower(): c for c in columns if c in keep}
    out = {}
    for c in columns:
        if c.lower() not in taken or taken[c.lower()] == c:
            taken[c.lower()] = out[c] = c
            continue
        k = 1
        while (name := f"{c}__src{'' if k == 1 else k}").lower() in taken:
            k += 1
        taken[name.lower()] = out[c] = name
    return out


def resolve(df: DataFrame, overrides: Mapping[str, str] | None = None) -> Resolution:
    """Roles by override, then known name, then part of the name, then what the values of a sample look like."""
    overrides = dict(overrides or {})
    found = Resolution()

    def claim(role: str, column: str, how: str) -> None:
        found.columns[role], found.how[role] = column, how

    for role, column in overrides.items():
        if column not in df.columns:
            raise UnresolvedRole(f"no column {column}")
        claim(role, column, "override")
    free = lambda: [c for c in df.columns if c not in found.columns.values()]
    for role, names in ALIASES.items():
        if role not in found.columns:
            hit = next((c for n in names for c in free() if plain(c) == plain(n)), None)
            if hit is not None:
                claim(role, hit, "exact")
    for role in REQUIRED:
        if role not in found.columns:
            hit = next((c for h in HINTS[role] for c in free() if h in plain(c)), None)
            if hit is not None:
                claim(role, hit, "fuzzy")
    open_roles = [r for r in REQUIRED if r not in found.columns]
    if open_roles and free():
        by = _profile(df, free())
        for role in ("timestamp", "case_id", "activity"):
            if role in open_roles and (hit := _fits(role, {c: by[c] for c in free() if c in by})):
                claim(role, hit, "type")
    missing = [r for r in REQUIRED if r not in found.columns]
    if missing:
        raise UnresolvedRole(f"no column for {', '.join(missing)}")
    return found


def _profile(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(share that parses as a time, share of distinct values, share that is no number) in a sample, by one aggregate."""
    sample, aggs = df.select(*(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns))).limit(SAMPLE_ROWS), []
    for k in range(len(columns)):
        c = F.col(f"c{k}")
        aggs += [
            F.avg(F.try_to_timestamp(c).isNotNull().cast("double")).alias(f"t{k}"),
            (F.count_distinct(c) / F.count(F.lit(1))).alias(f"d{k}"),
            F.avg(c.try_cast("double").isNull().cast("double")).alias(f"x{k}"),
        ]
    row = sample.agg(*aggs).first()
    return {c: (row[f"t{k}"] or 0.0, row[f"d{k}"] or 0.0, row[f"x{k}"] or 0.0) for k, c in enumerate(columns)}


def _fits(role: str, by: dict[str, tuple[float, float, float]]) -> str | None:
    if role == "timestamp":
        good = [c for c, (t, _, x) in by.items() if t >= PARSE_RATIO and x >= PARSE_RATIO]
        return max(good, key=lambda c: by[c][0], default=None)
    if role == "case_id":
        return min(by, key=lambda c: by[c][1], default=None)
    return max(by, key=lambda c: by[c][2] - abs(by[c][1] - 0.1), default=None)


def apply(df: DataFrame, found: Resolution) -> DataFrame:
    """df with role names; columns that already had such a name become <name>__src."""
    back = {c: r for r, c in found.columns.items()}
    names = []
    for c in df.columns:
        if c in back:
            names.append(back[c])
        else:
            names.append(f"{c}__src" if c in found.columns else c)
    unique = []
    taken: dict[str, int] = {}
    for original, name in zip(df.columns, names, strict=True):
        if name.lower() in taken and original not in back:
            name = f"{name}__src"
            k = 2
            while name.lower() in taken:
                name, k = f"{names[len(unique)]}__src{k}", k + 1
        taken[name.lower()] = 1
        unique.append(name)
    return df.toDF(*unique)
