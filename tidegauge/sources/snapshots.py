"""Latest versions kept as a snapshot, so that reading them does not reduce all history again.

A snapshot is a table with one row per key, bucketed and sorted by the keys. What
was written since (the tail) is reduced to its latest versions, dealt into the
snapshot's buckets and merged with it: the snapshot is read in place, only the
tail is shuffled. Advancing writes the merged rows as a new snapshot; since they
come out of the join by bucket already, that is no shuffle either.

Buckets are what bounds a task: choose them so that one holds some hundred
megabytes. Rows whose key is NULL are kept, reduced apart from the buckets.
Tables are named in the session's catalogue; ``open_snapshot`` names the files of
an earlier session again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.lookups import latest


def write_snapshot(df: DataFrame, table: str, path: str, keys: Sequence[str], version: str | Sequence[str], buckets: int) -> None:
    """The latest row per key of ``df`` as the new table ``table`` in ``path``."""
    _stored(latest(df, list(keys), version), table, path, keys, buckets)


def open_snapshot(spark: SparkSession, table: str, path: str, schema: str, keys: Sequence[str], buckets: int) -> None:
    """Names an existing snapshot's files in this session's catalogue."""
    names = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{path}'")


def read_latest(spark: SparkSession, table: str, tail: DataFrame, keys: Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """The latest row per key of snapshot and tail; of equal versions the snapshot's row stays.

    ``tail`` may hold late rows, rows the snapshot already has, and keys it does not know.
    """
    order = [version] if isinstance(version, str) else list(version)
    snapshot = spark.table(table)
    names = snapshot.columns
    known = _present(keys)
    fresh = latest(tail.filter(known).select(*names), list(keys), version).withColumnsRenamed({c: f"_{c}" for c in names})
    met = [F.col(k) == F.col(f"_{k}") for k in keys]
    # Merged, as a broadcast of the tail could not serve keys that the snapshot lacks.
    both = snapshot.filter(known).hint("merge").join(fresh, met, "full_outer")
    newer = F.col(keys[0]).isNull() | (F.struct(*[F.col(f"_{c}") for c in order]) > F.struct(*order))
    wins = F.col(f"_{keys[0]}").isNotNull() & newer
    merged = both.select(*[F.when(wins, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names])
    unkeyed = snapshot.filter(~known).unionByName(tail.filter(~known).select(*names))
    return merged.unionByName(latest(unkeyed, list(keys), version))


def advance_snapshot(spark: SparkSession, table: str, tail: DataFrame, keys: Sequence[str], version: str | Sequence[str],
                     to: str, path: str, buckets: int) -> None:
    """The snapshot and its tail as a new snapshot ``to``; readers change over when they are ready."""
    _stored(read_latest(spark, table, tail, keys, version), to, path, keys, buckets)


def _present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return present


def _stored(rows: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    (rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("errorifexists").saveAsTable(table))
