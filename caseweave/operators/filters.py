"""Row predicates of event pages and committed filters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.quantiles import quantiles

OPERATORS = ("is_null", "is_not_null", "contains", "equals", "gte", "lte", "in")


class UnknownField(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


def like(column: Column, value: str) -> Column:
    """Case-insensitive containment of the text form; % and _ in value are wildcards."""
    return column.cast("string").ilike(f"%{value}%")


def predicate(f: Filter) -> Column:
    c = F.col(f"`{f.field}`")
    match f.op:
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
        case "contains":
            return like(c, f.value)
        case "equals":
            return c == F.lit(f.value)
        case "gte":
            return c >= F.lit(f.value)
        case "lte":
            return c <= F.lit(f.value)
        case "in":
            return c.cast("string").isin([str(v) for v in f.value]) if f.value else F.lit(False)
    raise ValueError(f"unknown operator {f.op}")


def where(filters: Iterable[Filter], columns: Iterable[str], strict: bool = True) -> Column:
    """All filters together. Unknown fields raise, or are left out where strict is false (committed filters)."""
    names = set(columns)
    clauses = []
    for f in filters:
        if f.field in names:
            clauses.append(predicate(f))
        elif strict:
            raise UnknownField(f.field)
    return reduce(and_, clauses, F.lit(True))


def search(columns: Iterable[str], q: str) -> Column:
    """Free text in any column."""
    return reduce(or_, (like(F.col(f"`{c}`"), q) for c in columns), F.lit(False))


def missing(required: Iterable[str]) -> Column:
    """Whether any required column is null."""
    return reduce(or_, (F.col(f"`{c}`").isNull() for c in required), F.lit(False))


def parse_sort(spec: str | None, columns: Iterable[str], default: str = "case_id:asc,timestamp:asc") -> list[Column]:
    """Order columns from `col:asc,col2:desc`; unknown columns raise."""
    names, out = set(columns), []
    for part in (spec or default).split(","):
        name, _, way = part.strip().partition(":")
        if name not in names:
            raise UnknownField(name)
        out.append(F.col(f"`{name}`").desc() if way == "desc" else F.col(f"`{name}`").asc())
    return out


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def between(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Half-open time range [start, end)."""
    clauses = ([F.col(column) >= start] if start is not None else []) + ([F.col(column) < end] if end is not None else [])
    return df.where(reduce(and_, clauses, F.lit(True)))


def completed_only(df: DataFrame, column: str = "lifecycle") -> DataFrame:
    """Events whose lifecycle is complete, where there is such a column."""
    return df.where(F.col(column).isin("complete", "COMPLETE")) if column in df.columns else df


def without_outliers(df: DataFrame, column: str, m: float = 20.0) -> DataFrame:
    """Rows whose distance to the median is below m times the median distance (1 where that is 0)."""
    middle = quantiles(df, column, (0.5,)).select(F.col("q")[0].alias("cw_mid"))
    apart = df.crossJoin(F.broadcast(middle)).withColumn("cw_apart", F.abs(F.col(column) - F.col("cw_mid")))
    spread = quantiles(apart, "cw_apart", (0.5,)).select(F.col("q")[0].alias("cw_mad"))
    spread = spread.select(F.when(F.col("cw_mad") == 0, 1.0).otherwise(F.col("cw_mad")).alias("cw_mad"))
    kept = apart.crossJoin(F.broadcast(spread)).where(F.col("cw_apart") / F.col("cw_mad") < m)
    return kept.drop("cw_mid", "cw_apart", "cw_mad")
