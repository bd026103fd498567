"""Sampling, routing and per-minute roll-up of normalised rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.aggregates import resum, row_counters
from tidegauge.operators.timeseries import bucket
from tidegauge.sources.writers import write_facts
from tidegauge.spec import LogTable


# Facets fanned out per scan; see the note on shared scans of breakdowns.
FACETS_PER_SCAN = 5


def _fanned(df: DataFrame, table: LogTable, facets: Sequence[tuple[str, str]]) -> DataFrame:
    counters = row_counters(table)
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), F.coalesce(F.expr(dim), F.lit("")).alias("dim"))
                      for name, dim in facets])
    rows = df.select(bucket(table.time, timedelta(minutes=1)).alias("minute"),
                     *[c.alias(n) for n, c in counters.items()], pairs.alias("pairs"))
    fanned = rows.select("minute", F.inline("pairs"), *counters)
    return fanned.groupBy("minute", "facet", "dim").agg(*resum())


def minute_rollup(df: DataFrame, table: LogTable, facets: Mapping[str, str]) -> DataFrame:
    """(minute, facet, dim) counters: each row fans out to its facet values,
    which partial aggregation folds before the shuffle."""
    items = list(facets.items())
    parts = [_fanned(df, table, items[i:i + FACETS_PER_SCAN]) for i in range(0, len(items), FACETS_PER_SCAN)]
    return reduce(DataFrame.unionByName, parts)


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Additive merge of partial roll-ups; late rows are just another partial."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("minute", "facet", "dim").agg(*resum())


def compact_rollup(partials: DataFrame, path: str, days: Sequence[date] | None = None) -> None:
    """Periodic compaction: one row per (minute, facet, dim), by day, written to
    another place than the partials are read from.

    With ``days`` only those are read and replaced, so the work does not grow
    with the table and may be repeated when late partials came.
    """
    if days is None:
        write_facts(merge_rollups(partials), path, time="minute", sort=("facet",), mode="overwrite")
        return
    chosen = partials.filter(F.col("dt").isin(list(days))) if "dt" in partials.columns else partials.filter(F.to_date("minute").isin(list(days)))
    write_facts(merge_rollups(chosen), path, time="minute", sort=("facet",), mode="overwrite", only_days=True)


def sample_key(*columns: str) -> Column:
    """The stored sample hash, from the request id or from time and address."""
    return F.xxhash64(*[F.col(c) for c in columns])


def time_and_address(time: str = "timestamp", address: str = "cdn_originating_ip") -> Column:
    millis = F.unix_millis(F.col(time).cast("timestamp")).cast("string")
    return F.concat_ws(":", millis, F.col(address))


def sample_hash() -> Column:
    """The hash rows are sampled by on arrival."""
    return F.xxhash64(time_and_address())


def thin_out(df: DataFrame, rate: int, key: Column | None = None, weight: str = "weight") -> DataFrame:
    """Deterministic sampling: keep one in ``rate`` by hash and let each kept row
    stand for ``rate``. ``key`` is any well-spread integer."""
    key = sample_hash() if key is None else key
    return df.filter(F.pmod(key, F.lit(rate)) == 0).withColumn(weight, F.lit(rate))


def scaled_counters(names: Sequence[str], part: int, of: int) -> list[Column]:
    """Counters of a scan that read ``part`` of ``of`` sample parts, scaled up."""
    return [F.round(F.col(n) * F.lit(of) / F.lit(part)).cast("bigint").alias(n) for n in names]


def routes(admin_hosts: Sequence[str], authoring_hosts: Sequence[str]) -> dict[str, Column]:
    """Target table -> condition. A row may have several targets: every server
    error on the edge is also kept in the error table."""
    host = F.col("request_host")
    admin, authoring = host.isin(*admin_hosts), host.isin(*authoring_hosts)
    edge = F.col("cdn_is_edge") & ~admin & ~authoring
    return {
        "delivery": edge,
        "delivery_errors": edge & (F.col("response_status") >= 500),
        "admin": admin,
        "backend": ~F.col("cdn_is_edge") & ~admin & ~authoring,
        "authoring": authoring,
    }


def route(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, DataFrame]:
    return {target: df.filter(condition) for target, condition in rules.items()}
