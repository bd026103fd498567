"""Writing facts, roll-ups, versioned tables and exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.breakdown import EMPTY_LABEL, VALUE
from tidegauge.operators.lookups import latest
from tidegauge.operators.predicates import moment

# Header of the facet export.
EXPORT_HEADER = {"dim": "Value", "cnt": "Count", "cnt_ok": "OK (2xx/3xx)", "cnt_4xx": "4xx", "cnt_5xx": "5xx"}


# Sampled layouts: points a row's hash may take, and folders per day they are dealt into.
SAMPLE_SPACE, SAMPLE_BUCKETS = 1 << 20, 16
SAMPLE_POINT, SAMPLE_BUCKET = "sample_point", "sample_bucket"

# Parts a day is dealt into before sizes are known.
FILES_PER_DAY = 16


def with_day(df: DataFrame, time: str = "timestamp", day: str = "dt") -> DataFrame:
    return df.withColumn(day, F.to_date(time))


def write_facts(df: DataFrame, path: str, time: str = "timestamp", sort: Sequence[str] = ("request_host",),
                day: str = "dt", mode: str = "append", only_days: bool = False,
                bloom: Sequence[str] = ()) -> None:
    """Day folders, rows sorted so that row-group statistics prune.

    Rows are dealt by day and by a hash of what they are sorted by and the hour,
    so a day or host with a third of all rows is spread over tasks and files;
    adaptive execution splits what is still large and joins what is small. The
    input is read once, as no ranges have to be sampled. ``mode="overwrite"`` replaces the
    table, or with ``only_days`` just the days present, which makes a repeated
    load of a day harmless. ``bloom`` names id columns looked up by equality:
    their bloom filters skip row groups that statistics cannot.
    """
    dated = with_day(df, time, day)
    order = [day, *sort, time]
    dealt = dated.withColumn("_dealt", F.pmod(F.xxhash64(*sort, F.date_trunc("hour", F.col(time))), F.lit(FILES_PER_DAY)))
    writer = dealt.hint("rebalance", day, "_dealt").drop("_dealt").sortWithinPartitions(*order).write.mode(mode)
    writer = writer.option("partitionOverwriteMode", "dynamic" if only_days else "static")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(day).parquet(path)


def write_sampled(df: DataFrame, path: str, key: Column, time: str = "timestamp", sort: Sequence[str] = ("request_host",),
                  day: str = "dt", buckets: int = SAMPLE_BUCKETS, mode: str = "append") -> None:
    """Facts whose layout holds samples: folders by day and by sample bucket.

    ``key`` (any well-spread integer) gives each row a stored point in a sample
    space of ``SAMPLE_SPACE``, cut into equal buckets: a sample of one in N reads
    the folders of the buckets below its share and filters in the last of them
    alone (``readers.sample_pruned``). Smaller samples lie within larger ones.
    """
    if SAMPLE_SPACE % buckets:
        raise ValueError(f"{buckets} buckets do not divide the sample space of {SAMPLE_SPACE}")
    point = F.pmod(key, F.lit(SAMPLE_SPACE)).cast("int")
    rows = with_day(df, time, day).withColumn(SAMPLE_POINT, F.coalesce(point, F.lit(0)))
    rows = rows.withColumn(SAMPLE_BUCKET, F.floor(F.col(SAMPLE_POINT) * buckets / SAMPLE_SPACE).cast("int"))
    writer = rows.hint("rebalance", day, SAMPLE_BUCKET).sortWithinPartitions(day, SAMPLE_BUCKET, *sort, time).write.mode(mode)
    writer.partitionBy(day, SAMPLE_BUCKET).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def compact_versions(df: DataFrame, keys: Sequence[str], version: str | Sequence[str], path: str) -> None:
    """Rewrite a versioned table with one row per key, to another place than it
    is read from."""
    latest(df, keys, version).write.mode("overwrite").parquet(path)


def expire(df: DataFrame, keep: timedelta, as_of: datetime, time: str = "timestamp",
           day: str | None = None) -> DataFrame:
    """Rows within the retention; with a day column older folders are not read."""
    cut = as_of - keep
    kept = F.col(time) >= moment(df, time, cut)
    return df.filter(kept & (F.col(day) >= F.lit(cut.date()))) if day else df.filter(kept)


def drop_expired(spark: SparkSession, path: str, keep: timedelta, as_of: datetime, day: str = "dt") -> list[str]:
    """Deletes the day folders of a table that lie before the retention, at any depth; gives their names.

    Only whole days go: the day the retention begins in stays. A second run finds nothing to do.
    """
    cut = f"{day}={(as_of - keep).date()}"
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def expired(folder) -> list:
        inside = [f.getPath() for f in system.listStatus(folder) if f.isDirectory()]
        days = [p for p in inside if p.getName().startswith(f"{day}=")]
        return [p for p in days if p.getName() < cut] + [q for p in inside if p not in days for q in expired(p)]
    gone = expired(root)
    for folder in gone:
        system.delete(folder, True)
    return sorted({p.getName() for p in gone})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_rows(result: DataFrame) -> DataFrame:
    """A breakdown's rows under the export's column titles."""
    dim = F.coalesce(F.nullif(F.col("dim"), F.lit("")), F.lit(EMPTY_LABEL))
    rows = result.filter(F.col("kind") == VALUE) if "kind" in result.columns else result
    return rows.select(dim.alias(EXPORT_HEADER["dim"]),
                       *[F.col(c).alias(t) for c, t in EXPORT_HEADER.items() if c != "dim"])


def write_tsv(result: DataFrame, path: str) -> None:
    (export_rows(result).write.mode("overwrite").option("sep", "\t").option("header", True)
     .option("quote", "\u0000").option("escapeQuotes", False).csv(path))


def nested_json(df: DataFrame, groups: Sequence[str] = ("request_headers", "response_headers", "request",
                                                       "response", "cdn", "client", "platform")) -> Column:
    """A flat row as nested JSON text without empty values.

    Columns named with dots or with a group prefix nest under their group.
    """
    tree: dict = {}
    for name in df.columns:
        parts = name.split(".")
        if len(parts) == 1:
            group = next((g for g in groups if name.startswith(g + "_")), None)
            if group:
                parts = [*group.split("_"), name[len(group) + 1:]]
        node = tree
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = name

    def present(node: dict | str) -> Column:
        if isinstance(node, str):
            column = F.col(f"`{node}`")
            if df.schema[node].dataType.typeName() == "string":
                return F.nullif(column, F.lit(""))
            return column
        fields = [(k, present(v)) for k, v in node.items()]
        some = reduce(lambda a, b: a | b, [c.isNotNull() for _, c in fields])
        packed = F.struct(*[c.alias(k) for k, c in fields])
        return F.when(some, packed)

    return F.to_json(F.struct(*[present(v).alias(k) for k, v in tree.items()]))
