"""Row listings, value search, suggestions, paging and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.aggregates import dim_count
from tidegauge.operators.breakdown import by_count
from tidegauge.operators.predicates import both, minutes_between, moment, newer_than, page_filter
from tidegauge.operators.timeseries import bucket
from tidegauge.spec import MINUTE, Facet, LogTable, Query, TimeRange, floor_to

# Fixed values.
PAGE_ROWS = 500
CONFIG_PAGE_ROWS = 200
SEARCH_ROWS = 20
SHORTEST_PATTERN = 2
SUGGESTED_HOSTS = 100
MERGED_HOSTS = 200
SUGGESTIONS_SHOWN = 20


def minute_rows(df: DataFrame, table: LogTable) -> DataFrame:
    """``minute``, ``rows``: how many rows are stored per minute, a roll-up that partials add up to as well."""
    return df.groupBy(bucket(table.time, timedelta(minutes=1)).alias("minute")).agg(F.count(F.lit(1)).alias("rows"))


def _unfiltered(query: Query) -> bool:
    return not (query.host or query.owner_repo or query.search or query.filters or query.where)


def _page_begins(counts: DataFrame, rng: TimeRange, needed: int, below: datetime | None) -> datetime | None:
    """The newest minute from which on the range holds ``needed`` rows (below a time), if it holds as many.

    The minute of ``below`` itself does not count, as part of it is above. One row
    per minute of the range meets here, whatever the number of logs.
    """
    kept = minutes_between(counts, rng)
    if below:
        kept = kept & (F.col("minute") < moment(counts, "minute", floor_to(below, MINUTE)))
    minutes = counts.filter(kept).groupBy("minute").agg(F.sum("rows").alias("rows"))
    so_far = minutes.withColumn("n", F.sum("rows").over(Window.orderBy(F.col("minute").desc())))
    return so_far.filter(F.col("n") >= needed).agg(F.max("minute").cast("timestamp_ntz")).first()[0]


def log_page(df: DataFrame, table: LogTable, query: Query, page_rows: int = PAGE_ROWS,
             offset: int = 0, after: tuple[datetime, object] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Newest rows first, one page of whole rows.

    A first pass over the filter columns finds the time of the page's last row;
    the wide rows are then only read from there on, where that time prunes days
    and row groups. ``after`` continues below the last row seen, (time, id):
    its cost does not grow with the depth, unlike ``offset``, which has to pass
    all rows above.

    ``counts`` (``minute_rows``, partials allowed, never more than are stored)
    tells for queries without filters from which minute on the page's rows lie:
    both passes then read from there on instead of the whole range.
    """
    time = F.col(table.time)
    rows = df.filter(page_filter(df, table, query))
    begins = _page_begins(counts, query.range, offset + page_rows, after and after[0]) if counts is not None and _unfiltered(query) else None
    if begins:
        rows = rows.filter(time >= moment(df, table.time, begins))
        if table.day:
            rows = rows.filter(F.col(table.day) >= F.lit(begins.date()))
    order = [time.desc()]
    if table.id:
        order.append(F.col(table.id).desc())
    if after:
        seen, row_id = after
        last = moment(df, table.time, seen)
        # The first condition alone reaches the scan.
        rows = rows.filter((time <= last) & ((time < last) | (F.col(table.id) < F.lit(row_id))))
    newest = rows.select(table.time).orderBy(time.desc()).limit(offset + page_rows)
    oldest = newest.agg(F.min(table.time).alias("t"))
    rows = rows.filter(time >= oldest.scalar())
    if table.day:
        rows = rows.filter(F.col(table.day) >= oldest.select(F.to_date("t")).scalar())
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(page_rows)


def _search_values(df: DataFrame, table: LogTable, facet: Facet, query: Query) -> DataFrame:
    """Facet values with their count; the facet's own condition does not apply."""
    rows = df.filter(page_filter(df, table, query))
    value = F.explode(F.expr(facet.filter_col)) if facet.is_array else F.expr(facet.filter_col or facet.dim)
    keep = [c for c in [table.weight] if c]
    values = rows.select(value.alias("dim"), *keep)
    return values.groupBy(F.col("dim").cast("string").alias("dim")).agg(dim_count(table))


def next_values(df: DataFrame, table: LogTable, facet: Facet, query: Query,
                rows: int = SEARCH_ROWS) -> DataFrame:
    """The values that follow the ones a breakdown already shows."""
    return _search_values(df, table, facet, query).orderBy(*by_count()).offset(query.top).limit(rows)


def values_containing(df: DataFrame, table: LogTable, facet: Facet, query: Query, pattern: str,
                      rows: int = SEARCH_ROWS) -> DataFrame:
    """The most frequent values that contain the text literally."""
    found = _search_values(df, table, facet, query)
    if len(pattern) < SHORTEST_PATTERN:
        return found.limit(0)
    return found.filter(F.col("dim").contains(pattern)).orderBy(*by_count()).limit(rows)


def frequent_values(df: DataFrame, column: str, as_of: datetime, time: str = "timestamp",
                    age: timedelta = timedelta(days=1), non_empty: bool = False,
                    rows: int = SUGGESTED_HOSTS, day: str | None = None) -> DataFrame:
    """Most frequent values of the last day; rows count one each, unweighted."""
    kept = newer_than(df, age, as_of, time, day)
    if non_empty:
        kept = kept & (F.col(column) != "")
    counts = df.filter(kept).groupBy(F.col(column).alias("host")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), F.col("host")).limit(rows)


def merged_hosts(hosts: DataFrame, forwarded: DataFrame, rows: int = MERGED_HOSTS) -> DataFrame:
    """Both suggestion lists as one sorted set of single host names."""
    single = hosts.select("host")
    split = forwarded.select(F.explode(F.split("host", ",")).alias("host")).select(F.trim("host").alias("host"))
    return single.union(split).filter("host != ''").distinct().orderBy("host").limit(rows)


def function_names(functions: DataFrame, rows: int = MERGED_HOSTS) -> DataFrame:
    return functions.filter("host != ''").select("host").orderBy("host").limit(rows)


def owners_and_repos(df: DataFrame, table: LogTable, as_of: datetime,
                     age: timedelta = timedelta(days=7)) -> DataFrame:
    """All ``owner`` and ``owner/repo`` names of the last week, case ignored in order."""
    owner, repo = F.col(table.owner), F.col(table.repo)
    recent = df.filter(newer_than(df, age, as_of, table.time, table.day) & (owner != ""))
    pairs = recent.select(owner.alias("owner"), repo.alias("repo")).distinct()
    names = F.array(F.col("owner"), F.when(F.col("repo") != "", F.concat("owner", F.lit("/"), "repo")))
    listed = pairs.select(F.explode(F.array_compact(names)).alias("owner_repo")).distinct()
    return listed.orderBy(F.lower("owner_repo"), "owner_repo")


def ranked_suggestions(names: DataFrame, text: str, column: str = "owner_repo",
                       rows: int = SUGGESTIONS_SHOWN) -> DataFrame:
    """Owners starting with the text, then repos starting with it, then the rest."""
    if not text:
        return names.select(F.col(column), F.lit(0).alias("rank")).limit(0)
    value, wanted = F.lower(F.col(column)), text.lower()
    rank = (F.when(value.startswith(wanted), F.when(~F.col(column).contains("/"), 0).otherwise(1))
            .when(value.contains(wanted), 2))
    ranked = names.select(F.col(column), rank.alias("rank")).filter(F.col("rank").isNotNull())
    return ranked.orderBy("rank", value, F.col(column)).limit(rows)


def ordered(df: DataFrame, column: str, ascending: bool = True, ties: Sequence[Column | str] = ()) -> DataFrame:
    """Order by any column; text ignores case."""
    key = F.col(column)
    if df.schema[column].dataType.typeName() == "string":
        key = F.lower(key)
    return df.orderBy(key.asc() if ascending else key.desc(), *ties)


def page_of(df: DataFrame, page: int, order: Sequence[str], page_rows: int = CONFIG_PAGE_ROWS,
            after: Sequence[object] | None = None) -> DataFrame:
    """The n-th page (from 0) of a total order, or the page after the given key,
    whose cost does not grow with the depth."""
    rows = df
    if after is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(x).alias(c) for c, x in zip(order, after)]))
        page = 0
    rows = rows.orderBy(*order)
    return (rows.offset(page * page_rows) if page else rows).limit(page_rows)


def any_column_contains(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive containment in at least one of the columns."""
    if not text:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return both([hit])
