"""The four traffic counters (total, ok, 4xx, 5xx) in their four weightings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.spec import LogTable

COUNTERS = ("cnt", "cnt_ok", "cnt_4xx", "cnt_5xx")


def row_amount(table: LogTable, by_bytes: bool = False) -> Column:
    """What one stored row stands for: requests, or bytes, times its weight."""
    amount = F.lit(1).cast("bigint")
    if by_bytes:
        amount = F.col(table.bytes).cast("bigint")
    if table.weight:
        weight = F.col(table.weight).cast("bigint")
        amount = amount * weight if by_bytes else weight
    return amount


def row_counters(table: LogTable, by_bytes: bool = False) -> dict[str, Column]:
    """Per-row contributions to the counters, so that one ``sum`` finishes them."""
    amount = row_amount(table, by_bytes)
    zero = F.lit(0).cast("bigint")
    parts = {"cnt": amount}
    for label in ("ok", "4xx", "5xx"):
        parts[f"cnt_{label}"] = F.when(F.expr(table.counters[label]), amount).otherwise(zero)
    return parts


def sums(columns: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in columns.items()]


def resum(names: tuple[str, ...] | list[str] = COUNTERS) -> list[Column]:
    return sums({n: F.col(n) for n in names})


def traffic_counters(table: LogTable, by_bytes: bool = False) -> list[Column]:
    return sums(row_counters(table, by_bytes))


def dim_count(table: LogTable) -> Column:
    return sums({"cnt": row_amount(table)})[0]


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` or NULL where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
