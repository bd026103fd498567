"""Helpers shared by the operators on training text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import shared_folder

#: Characters that separate words, in every operator that speaks of words.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^ \t-\r]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch; a setting of the session that is read when a query runs.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, purpose: str, codec: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors.

    ``batch_bytes`` bounds the Arrow batches that its Python tasks are given.
    """
    path, conf = shared_folder(df.sparkSession, purpose), df.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    try:
        if batch_bytes:
            conf.set(BATCH_BYTES, str(batch_bytes))
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        conf.set(BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Maps Arrow batches; ``make`` builds the batch function once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield one(batch)
    return df.mapInArrow(run, schema)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def gapless(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Adds ``name``: 0, 1, 2, … within each value of ``by``, without one task per value.

    Rows are dealt into hash buckets of ``order``; a bucket starts after the
    rows of the buckets before it. ``df`` is read twice and must give the same
    rows each time, so pass a written table.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
              .select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (dealt.withColumn("_nth", F.row_number().over(inside) - 1)
            .join(starts, [*by, "_bucket"])
            .withColumn(name, F.col("_start") + F.col("_nth"))
            .drop("_bucket", "_nth", "_start"))


def id_ranges(df: DataFrame, column: str, ranges: int) -> list[int]:
    """Upper bounds that cut an integer column into ranges of similar row counts.

    Reads that column alone; at most ``ranges - 1`` numbers reach the driver.
    """
    if ranges < 2:
        return []
    points = [i / ranges for i in range(1, ranges)]
    found = df.select(F.percentile_approx(column, points, 100 * ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(column: str, bounds: list[int]) -> Column:
    """Number of the range a value lies in; NULL lies in the first."""
    if not bounds:
        return F.lit(0)
    ends = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.coalesce(F.size(F.filter(ends, lambda e: e < F.col(column))), F.lit(0))
