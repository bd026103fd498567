"""Declarative descriptions of log tables, facets, filters and queries.

Everything that names a column or a condition is a Spark SQL expression string,
so the objects are plain data: they can be built without a session, compared,
and shared between dashboards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta

MINUTE = timedelta(minutes=1)

# Range key -> (period, bucket width). The bucket of the three-day
# range is wider than that of the seven-day range; that is intended.
RANGE_PRESETS: dict[str, tuple[timedelta, timedelta]] = {
    "15m": (timedelta(minutes=15), timedelta(seconds=5)),
    "1h": (timedelta(hours=1), timedelta(seconds=10)),
    "12h": (timedelta(hours=12), timedelta(minutes=1)),
    "24h": (timedelta(hours=24), timedelta(minutes=5)),
    "3d": (timedelta(days=3), timedelta(minutes=30)),
    "7d": (timedelta(days=7), timedelta(minutes=10)),
    "14d": (timedelta(days=14), timedelta(minutes=20)),
}
DEFAULT_RANGE = "7d"

# Longest span -> bucket width for free ranges; longer spans use
# FREE_RANGE_WIDEST.
FREE_RANGE_STEPS: tuple[tuple[timedelta, timedelta], ...] = (
    (timedelta(minutes=15), timedelta(seconds=5)),
    (timedelta(minutes=60), timedelta(seconds=10)),
    (timedelta(minutes=720), timedelta(minutes=1)),
    (timedelta(minutes=1440), timedelta(minutes=5)),
)
FREE_RANGE_WIDEST = timedelta(minutes=10)

# Selectable numbers of breakdown rows.
TOP_N_CHOICES = (5, 10, 20, 50, 100)


def floor_to(moment: datetime, step: timedelta) -> datetime:
    return moment - (moment - datetime(1970, 1, 1)) % step


@dataclass(frozen=True)
class TimeRange:
    """A time span (UTC, naive) and the bucket width charts of it use."""

    start: datetime
    end: datetime
    step: timedelta

    @classmethod
    def preset(cls, key: str, as_of: datetime) -> TimeRange:
        period, step = RANGE_PRESETS[key]
        return cls(as_of - period, as_of, step)

    @classmethod
    def free(cls, start: datetime, end: datetime) -> TimeRange:
        span = end - start
        step = next((s for longest, s in FREE_RANGE_STEPS if span <= longest), FREE_RANGE_WIDEST)
        return cls(start, end, step)

    @property
    def first_minute(self) -> datetime:
        return floor_to(self.start, MINUTE)

    @property
    def last_minute(self) -> datetime:
        return floor_to(self.end, MINUTE)

    @property
    def until(self) -> datetime:
        """Exclusive end: the last minute counts whole."""
        return self.last_minute + MINUTE

    @property
    def fill_from(self) -> datetime:
        return floor_to(self.first_minute, self.step)

    @property
    def fill_to(self) -> datetime:
        """Exclusive end of generated buckets."""
        return floor_to(self.until - timedelta(milliseconds=1), self.step)


@dataclass(frozen=True)
class FacetFilter:
    """One include or exclude value on a facet. ``op`` is ``=``, ``LIKE`` or ``HAS``."""

    col: str
    value: str | int | float
    exclude: bool = False
    filter_col: str | None = None
    filter_value: str | int | float | None = None
    op: str = "="


@dataclass(frozen=True)
class Facet:
    """One way of breaking a table down.

    ``summary`` is a row condition whose share is reported next to the totals;
    ``dim_summary`` is the same condition on the dim value, for roll-up reads.
    ``buckets`` turns the numeric ``raw`` expression into a label for a given
    number of rows and ``labels`` lists the labels to expect.
    """

    name: str
    dim: str
    extra: str | None = None
    summary: str | None = None
    dim_summary: str | None = None
    rollup: str | None = None
    high_cardinality: bool = False
    by_bytes: bool = False
    is_array: bool = False
    filter_col: str | None = None
    filter_value: Callable[[str], str | int] | None = field(default=None, compare=False)
    filter_op: str = "="
    raw: str | None = None
    buckets: Callable[[int, str], str] | None = field(default=None, compare=False)
    labels: Callable[[int], list[str]] | None = field(default=None, compare=False)
    dictionary: bool = False
    rollup_exact: bool = True

    def filter(self, value: str, exclude: bool = False) -> FacetFilter:
        """The filter that selecting (or excluding) a displayed value stands for."""
        mapped = self.filter_value(value) if self.filter_value else None
        return FacetFilter(self.dim, value, exclude, self.filter_col, mapped, self.filter_op)


# The three counters as row conditions.
STATUS_COUNTERS = {
    "ok": "response_status < 400",
    "4xx": "response_status >= 400 AND response_status < 500",
    "5xx": "response_status >= 500",
}
LEVEL_COUNTERS = {
    "ok": "lower(level) NOT IN ('error', 'warn', 'warning')",
    "4xx": "lower(level) IN ('warn', 'warning')",
    "5xx": "lower(level) = 'error'",
}
# A failed worker call that also answered 4xx counts under both headings.
OUTCOME_COUNTERS = {
    "ok": "outcome NOT IN ('exception', 'exceeded') AND (response_status = 0 OR response_status < 400)",
    "4xx": "response_status >= 400 AND response_status < 500",
    "5xx": "outcome IN ('exception', 'exceeded') OR response_status >= 500",
}


@dataclass(frozen=True)
class LogTable:
    """How one log table is timed, weighed, classified and broken down."""

    name: str
    counters: Mapping[str, str] = field(default_factory=lambda: STATUS_COUNTERS)
    weight: str | None = None
    time: str = "timestamp"
    day: str | None = None
    id: str | None = None
    bytes: str = "response_headers_content_length"
    hosts: tuple[str, ...] = ("request_host", "request_headers_x_forwarded_host")
    owner: str = "platform_owner"
    repo: str = "platform_repo"
    message: str | None = None
    request_id: str | None = None
    facets: Mapping[str, Facet] = field(default_factory=dict)
    has_rollup: bool = False
    rollup_high_cardinality: bool = False


@dataclass(frozen=True)
class Query:
    """What a dashboard page asks of a table: range, texts, facet filters."""

    range: TimeRange
    host: str = ""
    host_column: str | None = None
    owner_repo: str = ""
    owner_repo_exact: bool = False
    search: str = ""
    filters: tuple[FacetFilter, ...] = ()
    where: str | None = None
    by_bytes: bool = False
    top: int = 5
