"""Reading raw logs and stored tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.predicates import in_range
from tidegauge.sources.writers import SAMPLE_BUCKET, SAMPLE_BUCKETS, SAMPLE_POINT, SAMPLE_SPACE
from tidegauge.spec import TimeRange

RETENTION = {"facts": timedelta(days=14), "rollup": timedelta(days=14), "staging": timedelta(days=1)}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(Gzipped) JSON lines with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def stream_json_lines(spark: SparkSession, path: str, schema: str,
                      files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def read_facts(spark: SparkSession, path: str, rng: TimeRange | None = None, time: str = "timestamp",
               day: str = "dt") -> DataFrame:
    """A day-partitioned fact table; a range prunes day folders and row groups."""
    facts = spark.read.parquet(path)
    return facts.filter(in_range(facts, rng, time, day)) if rng else facts


def sample(df: DataFrame, part: int, of: int, key: str = "sample_hash") -> DataFrame:
    """The rows whose stored sample hash falls into ``part`` of ``of`` parts."""
    return df.filter(F.pmod(F.col(key), F.lit(of)) < part)


def sample_pruned(df: DataFrame, part: int, of: int, buckets: int = SAMPLE_BUCKETS) -> DataFrame:
    """``part`` in ``of`` rows of a table of ``write_sampled``; folders of other buckets are not read.

    The bucket is a folder name, so what is read falls with the sample; the
    row filter works in the one bucket the share ends in. ``buckets`` are those
    the table was written with. Scale counters with ``rollup.scaled_counters``.
    """
    if not 0 < part <= of:
        raise ValueError(f"{part} of {of} is no sample")
    end = -(-SAMPLE_SPACE * part // of)  # points below it are in the sample
    last = (end - 1) * buckets // SAMPLE_SPACE
    return df.filter((F.col(SAMPLE_BUCKET) <= last) & (F.col(SAMPLE_POINT) < end)).drop(SAMPLE_POINT, SAMPLE_BUCKET)
