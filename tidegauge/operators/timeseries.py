"""Traffic over time: buckets, counters per bucket, gap filling, stacking."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.operators.aggregates import COUNTERS, resum, row_counters, sums
from tidegauge.operators.predicates import page_filter
from tidegauge.spec import LogTable, Query, TimeRange

CLASSES = ("cnt_ok", "cnt_4xx", "cnt_5xx")


def bucket(time: Column | str, step: timedelta) -> Column:
    """Start of the bucket a time falls in; keeps the column's timestamp type."""
    return F.window(time, f"{int(step.total_seconds())} seconds").getField("start")


def _zeros() -> list[Column]:
    return [F.lit(0).cast("bigint").alias(c) for c in CLASSES]


def bucket_starts(rng: TimeRange, kind: str) -> Column:
    """Array of all bucket starts of a range, from inclusive, to exclusive."""
    last = rng.fill_to - rng.step
    if last < rng.fill_from:
        return F.array().cast(f"array<{kind}>")
    start, stop = (F.lit(m.isoformat(sep=" ")).cast(kind) for m in (rng.fill_from, last))
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(rng.step.total_seconds()))
    return F.sequence(start, stop, width)


def classes_over_time(df: DataFrame, table: LogTable, query: Query, keys: Sequence[str] = (),
                      fill: bool = True) -> DataFrame:
    """ok / 4xx / 5xx per bucket, optionally per series key, gaps as zero rows.

    Without keys the zero rows join the facts before the aggregation, so filling
    costs no extra shuffle; with keys see ``fill_series``. Buckets with data
    outside the generated span are kept.
    """
    counters = row_counters(table)
    kept = df.filter(page_filter(df, table, query))
    rows = kept.select(*keys, bucket(table.time, query.range.step).alias("t"),
                       *[counters[c].alias(c) for c in CLASSES])
    kind = df.schema[table.time].dataType.simpleString()
    if not fill:
        return rows.groupBy(*keys, "t").agg(*resum(CLASSES))
    if not keys:
        spine = df.sparkSession.range(0, 1, 1, 1).select(
            F.explode(bucket_starts(query.range, kind)).alias("t"), *_zeros())
        return rows.unionByName(spine).groupBy("t").agg(*resum(CLASSES))
    series = rows.groupBy(*keys, "t").agg(*resum(CLASSES))
    return fill_series(series, query.range, keys)


def fill_series(series: DataFrame, rng: TimeRange, keys: Sequence[str]) -> DataFrame:
    """Zero rows for the missing buckets of every series.

    Every row brings along the gap up to its successor, the first one also the
    gap before itself: one pass over rows already reduced to (key, bucket), and
    a series is never longer than the range has buckets.
    """
    kind = series.schema["t"].dataType.simpleString()
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(rng.step.total_seconds()))
    first, end = (F.lit(m.isoformat(sep=" ")).cast(kind) for m in (rng.fill_from, rng.fill_to))
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t")
    t = F.col("t")

    def between(start: Column, stop: Column) -> Column:
        """Bucket starts from ``start`` to before ``stop``."""
        return F.when(start < stop, F.sequence(start, stop - width, width)).otherwise(
            F.array().cast(f"array<{kind}>"))

    following = between(F.greatest(t + width, first), F.least(F.coalesce("following", end), end))
    leading = F.when(F.col("leads"), between(first, F.least(t, end))).otherwise(F.array().cast(f"array<{kind}>"))
    present = F.struct(t.alias("t"), *[F.col(c) for c in CLASSES])
    absent = F.transform(F.concat(leading, following), lambda gap: F.struct(gap.alias("t"), *_zeros()))
    rows = series.withColumns({"following": F.lead("t").over(along), "leads": F.lag("t").over(along).isNull()})
    return rows.select(*keys, F.inline(F.concat(F.array(present), absent)))


def stacked(series: DataFrame) -> DataFrame:
    """Cumulative heights of the three classes."""
    ok, client, server = (F.col(c) for c in CLASSES)
    return series.withColumns({"stack_ok": ok, "stack_4xx": ok + client, "stack_5xx": ok + client + server})


def chart_total(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Requests in the chart and its y limit: the tallest bucket, rounded up to
    a multiple of four (at least four)."""
    height = F.col("cnt_ok") + F.col("cnt_4xx") + F.col("cnt_5xx")
    tallest = F.max(height)
    return series.groupBy(*keys).agg(
        F.coalesce(F.sum(height), F.lit(0)).cast("bigint").alias("total"),
        F.greatest(F.lit(4), F.ceil(F.coalesce(tallest, F.lit(0)) / 4) * 4).cast("bigint").alias("y_max"))


def last_fifth(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last bucket of the most recent 20 % of every series that has
    at least two buckets. A series is at most one row per bucket of the range."""
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    indexed = series.select(
        *keys, "t",
        (F.row_number().over(whole.orderBy("t")) - 1).alias("i"),
        F.count(F.lit(1)).over(whole).alias("n"))
    tail = indexed.filter((F.col("n") >= 2) & (F.col("i") >= F.floor(F.col("n") * 0.8)))
    spans = tail.groupBy(*keys).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return spans.filter(F.col("start").isNotNull())


def snap_ranges(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Whole-minute ranges: ends in order, at least three minutes wide.

    Too narrow ranges grow around their middle.
    """
    low, high = F.least(start, end), F.greatest(start, end)

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    minute = F.lit(60_000_000)
    first = F.floor(micros(low) / minute)
    last = F.ceil(micros(high) / minute)
    last = F.greatest(last, first + 1)
    narrow = (last - first) < 3
    middle = (first + last) / 2
    kind = ranges.schema[start].dataType.simpleString()

    def back(c: Column) -> Column:
        return F.timestamp_seconds(c * 60).cast(kind)

    new_first = F.when(narrow, F.floor(middle - 1.5)).otherwise(first)
    new_last = F.when(narrow, F.ceil(middle + 1.5)).otherwise(last)
    return ranges.withColumns({start: back(new_first), end: back(new_last)})


def counters_in_ranges(df: DataFrame, table: LogTable, ranges: DataFrame, keys: Sequence[str],
                       start: str = "start", end: str = "end") -> DataFrame:
    """Counters of many (snapped) ranges at once, end minute excluded.

    A range's counters are the running totals at its end less those at its
    start: two rows per range for an equi-join, however long it is. Facts are
    reduced to minutes first; totals run over the minutes of each day, those
    asked for included, and over the days.
    """
    def minute(column: str) -> Column:
        return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 60)

    def before(window: WindowSpec) -> list[Column]:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in COUNTERS]

    ends = ranges.filter(minute(start) < minute(end)).select(*keys, F.inline(F.array(*[
        F.struct(minute(column).alias("_minute"), F.lit(sign).cast("bigint").alias("_sign"))
        for column, sign in ((start, -1), (end, 1))])))
    rows = df.select(minute(table.time).alias("_minute"), *[c.alias(n) for n, c in row_counters(table).items()])
    asked = ends.select("_minute").distinct().select("_minute", *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS])
    minutes = (rows.filter(F.col("_minute").isNotNull()).groupBy("_minute").agg(*resum()).unionByName(asked)
               .groupBy("_minute").agg(*resum()).withColumn("_day", F.floor(F.col("_minute") / 1440)))
    inside = minutes.select("_day", "_minute", *before(Window.partitionBy("_day").orderBy("_minute")))
    days = minutes.groupBy("_day").agg(*resum()).select("_day", *before(Window.partitionBy(F.lit(0)).orderBy("_day")))
    totals = inside.alias("i").join(days.alias("d"), "_day").select(
        "_minute", *[(F.col(f"i.{c}") + F.col(f"d.{c}")).alias(c) for c in COUNTERS])
    # Merged at every size: ends derived from a small file are still two rows per range, too many to broadcast.
    return ends.hint("merge").join(totals, "_minute").groupBy(*keys).agg(*sums({c: F.col("_sign") * F.col(c) for c in COUNTERS}))
