"""Building blocks for the comparison SQL."""

from __future__ import annotations

COUNTERS = ["cnt", "cnt_ok", "cnt_4xx", "cnt_5xx"]

# Written out here, not taken from the library: what the SQL counts must not follow a mistake there.
STATUS_COUNTERS = {
    "ok": "response_status < 400",
    "4xx": "response_status BETWEEN 400 AND 499",
    "5xx": "response_status > 499",
}
LEVEL_COUNTERS = {
    "ok": "lower(level) <> 'error' AND lower(level) <> 'warn' AND lower(level) <> 'warning'",
    "4xx": "lower(level) = 'warn' OR lower(level) = 'warning'",
    "5xx": "lower(level) = 'error'",
}
OUTCOME_COUNTERS = {
    "ok": "outcome <> 'exception' AND outcome <> 'exceeded' AND response_status < 400",
    "4xx": "response_status BETWEEN 400 AND 499",
    "5xx": "outcome = 'exception' OR outcome = 'exceeded' OR response_status > 499",
}
MONTH_WHERE = "timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31 00:01:00'"


def counters(amount: str = "weight", conditions: dict[str, str] = STATUS_COUNTERS,
             summary: str | None = None, summary_amount: str | None = None) -> str:
    parts = [f"CAST(coalesce(sum({amount}), 0) AS BIGINT) AS cnt"]
    for name, condition in conditions.items():
        parts.append(f"CAST(coalesce(sum(CASE WHEN {condition} THEN {amount} ELSE 0 END), 0) AS BIGINT) AS cnt_{name}")
    if summary:
        parts.append(f"CAST(coalesce(sum(CASE WHEN {summary} THEN {summary_amount or amount} ELSE 0 END), 0) AS BIGINT) AS summary_cnt")
    return ", ".join(parts)


def groups(view: str, dim: str, where: str = MONTH_WHERE, more: str = "", **options) -> str:
    return f"SELECT {dim} AS dim, {counters(**options)}{more} FROM {view} WHERE {where} GROUP BY 1"


def resum(names: list[str]) -> str:
    return ", ".join(f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}" for n in names)


def top_and_totals(source: str, n: int = 5, order: str = "cnt DESC, dim ASC", summary: bool = False,
                   other: bool = False) -> str:
    """Top rows, totals and other row of a CTE with (dim, counters)."""
    names = COUNTERS + (["summary_cnt"] if summary else [])
    cols = ", ".join(names)
    top = f"SELECT * FROM {source} ORDER BY {order} LIMIT {n}"
    parts = [f"SELECT 'value' AS kind, dim, {cols} FROM ({top})",
             f"SELECT 'total', NULL, {resum(names)} FROM {source}"]
    if other:
        minus = ", ".join(f"CAST(a.{c} - b.{c} AS BIGINT)" for c in names)
        parts.append(f"SELECT 'other', NULL, {minus} FROM (SELECT {resum(names)} FROM {source}) a, "
                     f"(SELECT {resum(names)} FROM ({top})) b WHERE a.cnt > b.cnt")
    return " UNION ALL ".join(parts)


def breakdown(view: str, dim: str, where: str = MONTH_WHERE, n: int = 5, other: bool = False, **options) -> str:
    body = groups(view, dim, where, **options)
    return f"WITH g AS ({body}) {top_and_totals('g', n, summary=bool(options.get('summary')), other=other)}"
