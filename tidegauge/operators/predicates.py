"""Row predicates: time ranges, texts, facet filters, categories.

All of them are plain column expressions. Time predicates are half-open ranges
on the bare column, typed like the column, so that they reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.spec import FacetFilter, LogTable, Query, TimeRange

_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)

# The operators a facet filter may use.
FILTER_OPS = ("=", "LIKE", "HAS")


def everything() -> Column:
    return F.lit(True)


def both(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, everything())


def either(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def moment(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the column's own timestamp type (a cast on the column would
    hide it from the scan)."""
    kind = df.schema[column].dataType.simpleString()
    return F.lit(value.isoformat(sep=" ")).cast(kind)


def in_range(df: DataFrame, rng: TimeRange, time: str = "timestamp", day: str | None = None) -> Column:
    """Rows from the first whole minute to the last whole minute, both included."""
    parts = [
        F.col(time) >= moment(df, time, rng.first_minute),
        F.col(time) < moment(df, time, rng.until),
    ]
    if day:
        parts.append(F.col(day).between(F.lit(rng.first_minute.date()), F.lit(rng.last_minute.date())))
    return both(parts)


def minutes_between(df: DataFrame, rng: TimeRange, minute: str = "minute", day: str | None = None) -> Column:
    """The same range on a per-minute roll-up, closed at both ends."""
    parts = [F.col(minute).between(moment(df, minute, rng.first_minute), moment(df, minute, rng.last_minute))]
    if day:
        parts.append(F.col(day).between(F.lit(rng.first_minute.date()), F.lit(rng.last_minute.date())))
    return both(parts)


def newer_than(df: DataFrame, age: timedelta, as_of: datetime, time: str = "timestamp",
               day: str | None = None) -> Column:
    cut = as_of - age
    parts = [F.col(time) > moment(df, time, cut)]
    if day:
        parts.append(F.col(day) >= F.lit(cut.date()))
    return both(parts)


def host_contains(text: str, columns: Iterable[str]) -> Column:
    return either(F.col(c).contains(text) for c in columns) if text else everything()


def owner_repo_matches(text: str, owner: str, repo: str, exact: bool = False) -> Column:
    if not text:
        return everything()
    owner_text, slash, repo_text = text.partition("/")
    if not slash:
        return F.col(owner).contains(text) | F.col(repo).contains(text)
    if exact:
        return (F.col(owner) == owner_text) & (F.col(repo) == repo_text)
    return F.col(owner).contains(owner_text) & F.col(repo).contains(repo_text)


def search_matches(text: str, message: str | None, request_id: str | None) -> Column:
    """A UUID looks up the request id; any other text is searched in the message."""
    if text and request_id and _UUID.fullmatch(text):
        return F.col(request_id) == text
    if text and message:
        return F.col(message).contains(text)
    return everything()


def _compare(flt: FacetFilter) -> Column:
    column = F.expr(flt.filter_col or flt.col)
    value = flt.value if flt.filter_value is None else flt.filter_value
    if flt.op == "HAS":
        return F.array_contains(column, value)
    if flt.op == "LIKE":
        return column.like(value)
    return column == F.lit(value)


def facet_filters(filters: Iterable[FacetFilter], known: Iterable[str] | None = None) -> Column:
    """Includes of one column are alternatives, excludes all apply, columns combine.

    Filters on columns outside ``known`` or with an unknown operator are dropped.
    """
    allowed = None if known is None else set(known)
    by_column: dict[str, tuple[list[Column], list[Column]]] = {}
    for flt in filters:
        key = flt.filter_col or flt.col
        if flt.op not in FILTER_OPS or (allowed is not None and key not in allowed):
            continue
        wanted, unwanted = by_column.setdefault(key, ([], []))
        (unwanted if flt.exclude else wanted).append(_compare(flt))
    parts: list[Column] = []
    for wanted, unwanted in by_column.values():
        if wanted:
            parts.append(either(wanted))
        parts.extend(~c for c in unwanted)
    return both(parts)


def without_own(filters: Iterable[FacetFilter], facet_dim: str) -> tuple[FacetFilter, ...]:
    """A facet shows all its values, so it ignores filters set on itself."""
    return tuple(f for f in filters if f.col != facet_dim)


def known_columns(table: LogTable) -> set[str]:
    return {f.filter_col or f.dim for f in table.facets.values()}


def page_filter(df: DataFrame, table: LogTable, query: Query,
                filters: Iterable[FacetFilter] | None = None) -> Column:
    """Everything a page restricts rows by: range, host, owner, search, facets, where."""
    parts = [
        in_range(df, query.range, table.time, table.day),
        host_contains(query.host, (query.host_column,) if query.host_column else table.hosts),
        owner_repo_matches(query.owner_repo, table.owner, table.repo, query.owner_repo_exact),
        search_matches(query.search, table.message, table.request_id),
        facet_filters(query.filters if filters is None else filters, known_columns(table) or None),
    ]
    if query.where:
        parts.append(F.expr(query.where))
    return both(parts)


def category_matches(category: str, status: str = "response_status") -> Column:
    """Rows behind an anomaly category; an unknown category keeps every row."""
    column = F.col(status)
    return {
        "red": column >= 500,
        "yellow": (column >= 400) & (column < 500),
        "green": column < 400,
    }.get(category, everything())
