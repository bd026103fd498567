"""Small column functions shared by ingest, facets and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as an unsigned or a floating number.
UNSIGNED = "^[0-9]+$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

EPOCH = "1970-01-01 00:00:00"

# The date layouts tried, most specific first. Weekday names are
# cut off before parsing.
DATE_LAYOUTS = (
    "dd MMM yyyy HH:mm:ss z",
    "dd-MMM-yy HH:mm:ss z",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)


def text(column: Column | str) -> Column:
    """Absent text is the empty string throughout the fact tables."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unsigned_or_zero(column: Column, kind: str = "bigint") -> Column:
    """The number if the whole text is one, else 0. Out-of-range text is 0 too.

    The column is named once: Spark then takes a field out of a record that a query
    builds, where with a second use it would build the whole record for each row.
    """
    return F.coalesce(F.regexp_extract(column, UNSIGNED, 0).try_cast(kind), F.lit(0)).cast(kind)


def double_or_zero(column: Column) -> Column:
    return F.coalesce(F.when(column.rlike(NUMBER), column.try_cast("double")), F.lit(0.0))


def unsigned_or_zero_sql(column: str) -> str:
    return f"coalesce(CASE WHEN {column} RLIKE '{UNSIGNED}' THEN try_cast({column} AS bigint) END, 0L)"


def double_or_zero_sql(column: str) -> str:
    return f"coalesce(CASE WHEN {column} RLIKE '{NUMBER}' THEN try_cast({column} AS double) END, 0D)"


def date_or_epoch(column: Column) -> Column:
    """Timestamp from the usual header and ISO layouts; the epoch if none fits.

    The shape of the text chooses the layouts worth trying, and an absent text,
    which is the usual case, none. The text is trimmed once: a lambda binds it.
    """
    epoch = F.lit(EPOCH).cast("timestamp")

    def parsed(bare: Column) -> Column:
        def first(layouts: Sequence[str]) -> Column:
            return F.coalesce(*[F.try_to_timestamp(bare, F.lit(layout)) for layout in layouts], epoch)
        named, dashed, timed = DATE_LAYOUTS[:1], DATE_LAYOUTS[1:2], DATE_LAYOUTS[2:]
        return (F.when(bare.rlike("^[0-9]{4}-"), first(timed)).when(bare.rlike("^[0-9]+ "), first(named))
                .when(bare.rlike("^[0-9]+-"), first(dashed)).otherwise(epoch))
    trimmed = F.regexp_replace(F.trim(column), "^[A-Za-z]+, *", "")
    return F.when(F.coalesce(column, F.lit("")) == "", epoch).otherwise(F.transform(F.array(trimmed), parsed)[0])


def from_epoch_millis(column: Column) -> Column:
    return F.timestamp_millis(column)


def from_epoch_nanos(column: Column) -> Column:
    """Milliseconds are what the fact tables keep; integers throughout, rounded down."""
    whole = column - F.pmod(column, F.lit(1_000_000))
    return F.timestamp_millis(F.call_function("div", whole, F.lit(1_000_000).cast("bigint")))


def hours_crossed(first: Column, last: Column) -> Column:
    """Hour boundaries between two instants (00:59 to 01:01 is one)."""
    def hour(c: Column) -> Column:
        return F.floor(F.unix_timestamp(c.cast("timestamp")) / 3600)
    return (hour(last) - hour(first)).cast("bigint")


def days_crossed(first: Column, last: Column) -> Column:
    return F.datediff(last, first).cast("bigint")


def first_item(column: Column, separator: str) -> Column:
    return F.split_part(column, F.lit(separator), F.lit(1))


def url_host(column: Column) -> Column:
    return F.try_parse_url(column, F.lit("HOST"))
