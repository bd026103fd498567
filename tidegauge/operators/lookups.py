"""Lookups between tables: latest versions, request ids, releases, nearest points."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.predicates import moment
from tidegauge.operators.timeseries import bucket
from tidegauge.spec import TimeRange

# Fixed values.
MATCHES_PER_ID = 5
NO_REQUEST_ID = ("", "0")


def latest(df: DataFrame, keys: Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """The last version of every key.

    An aggregate, so versions are reduced before the shuffle and a key with very
    many of them costs one row per task. Spark sorts each task's rows by key for
    it, which spills to disk where memory is short. List further ordering columns to make
    equal versions decidable.
    """
    versions = [version] if isinstance(version, str) else list(version)
    order = F.struct(*versions) if len(versions) > 1 else F.col(versions[0])
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("last"))
    return last.select(*keys, "last.*").select(*[F.col(f"`{c}`") for c in df.columns])


def name_of_number(rows: DataFrame, number: str, name: str, seen: str) -> DataFrame:
    """Dictionary number -> newest non-empty name, from log rows.

    Pairs are counted down by hash aggregation first; only they, not the log
    rows, are ordered by age.
    """
    pairs = (rows.filter((F.col(name) != "") & (F.col(number) > 0))
             .groupBy(F.col(number).alias("asn"), F.col(name).alias("name")).agg(F.max(seen).alias("seen")))
    return pairs.groupBy("asn").agg(
        F.max_by(F.col("name"), F.struct("seen", "name")).alias("name"), F.max("seen").alias("last_seen"))


def matches_by_request_id(ids: DataFrame, rows: DataFrame, columns: Sequence[str], key: str = "ray_id",
                          time: str = "timestamp", most: int = MATCHES_PER_ID, tie: Sequence[str] = ()) -> DataFrame:
    """For every request id on one side, the first ``most`` rows of the other.

    Ids that mark internal calls are dropped and the rest reduced to distinct
    ones. Rows are joined to them by their measured size: adaptive execution
    broadcasts few ids and splits an id that holds a third of all rows. The row
    number limit then applies before anything is shuffled per id, so such an id
    ships ``most`` rows per task.
    """
    usable = ~F.col(key).isin(*NO_REQUEST_ID)
    wanted = ids.filter(usable).select(key).distinct()
    found = rows.filter(usable).select(key, time, *columns, *[t for t in tie if t not in columns])
    order = Window.partitionBy(key).orderBy(time, *tie)
    match = F.row_number().over(order).cast("bigint")
    first = found.join(wanted, key, "left_semi").withColumn("match", match).filter(F.col("match") <= most)
    return first.select(key, "match", time, *columns)


def rows_of_request_id(rows: DataFrame, request_id: str, columns: Sequence[str], key: str = "ray_id",
                       time: str = "timestamp", most: int = MATCHES_PER_ID,
                       tie: Sequence[str] = ()) -> DataFrame:
    """The single-id form: a pushed-down equality and the first few rows."""
    if request_id in NO_REQUEST_ID:
        return rows.select(time, *columns).limit(0)
    return rows.filter(F.col(key) == request_id).orderBy(time, *tie).limit(most).select(time, *columns)


# Columns shown of the other side's rows.
ACCESS_COLUMNS = ("request_host", "request_url", "request_method", "response_status",
                  "cdn_script_name", "cdn_time_elapsed_msec", "response_headers_x_error")
WORKER_COLUMNS = ("script_name", "outcome", "response_status", "cpu_ms", "wall_ms", "logs", "exceptions")


def releases_in(releases: DataFrame, rng: TimeRange) -> DataFrame:
    """Latest version of every release published in the range, both ends included."""
    current = latest(releases, ["repo", "tag"], "_version")
    return current.filter(F.col("published").between(
        moment(releases, "published", rng.start), moment(releases, "published", rng.end)))


def release_overlay(series: DataFrame, releases: DataFrame, rng: TimeRange,
                    special_repos: Sequence[str] = ()) -> DataFrame:
    """Releases placed on the chart: their bucket's counters, their position on
    the time axis (0 to 1) and whether they get the maintenance mark."""
    span = (rng.end - rng.start).total_seconds()
    placed = releases_in(releases, rng).withColumns({
        "t": bucket("published", rng.step),
        "position": (F.unix_micros(F.col("published").cast("timestamp"))
                     - F.unix_micros(F.lit(rng.start.isoformat(sep=" ")).cast("timestamp"))) / (span * 1e6),
        "maintenance": F.col("repo").isin(*special_repos) if special_repos else F.lit(False),
    })
    return placed.join(series, "t", "left")


def nearest_points(points: DataFrame, probes: DataFrame, keys: Sequence[str], step: timedelta,
                   time: str = "t", probe_time: str = "at") -> DataFrame:
    """For every probe the nearest bucket of its series, the earlier one on a tie.

    ``step`` is the series' bucket width. Each bucket that holds a point or a
    probe learns the closest points at or before and after it - a series has no
    more buckets than its range - and probes equi-join their bucket. A series
    that receives a third of all probes is split by bucket, and a bucket that
    does, by adaptive execution.
    """
    present = points.select(*keys, bucket(time, step).alias("slot")).distinct().withColumn("p", F.col("slot"))
    asked = probes.withColumn("slot", bucket(probe_time, step))
    slots = present.join(asked.select(*keys, "slot").distinct(), [*keys, "slot"], "full")
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("slot")
    around = slots.select(
        *keys, "slot",
        F.last("p", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("low"),
        F.first("p", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("high"))

    def micros(column: str) -> Column:
        return F.unix_micros(F.col(column).cast("timestamp"))

    take_low = F.col("high").isNull() | (
        micros(probe_time) - micros("low") <= micros("high") - micros(probe_time))
    nearest = F.when(F.coalesce(take_low, F.lit(False)), F.col("low")).otherwise(F.col("high"))
    joined = asked.join(around, [*keys, "slot"], "left")
    return joined.withColumn("nearest", nearest).drop("low", "high", "slot")
