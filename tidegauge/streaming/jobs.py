"""Continuous ingest: staging -> normalised facts -> per-minute roll-up.

Every micro-batch writes below a folder of its own, named by the stream's
source, by the query that runs it and by the batch, and overwrites it: a batch
that is run again after a failure replaces itself instead of counting twice.
Streams of different sources share a table, and a stream that starts over with a
new checkpoint is another query, so neither can touch what others wrote. Readers
see one table, partitioned by these names and, where rows have a time, by day.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidegauge.operators.aggregates import COUNTERS, row_counters
from tidegauge.operators.lookups import latest
from tidegauge.sources.rollup import minute_rollup, sample_hash
from tidegauge.sources.writers import with_day, write_facts
from tidegauge.spec import LogTable

SOURCE, RUN, BATCH, TARGET, DAY = "stream_source", "stream_run", "batch", "target", "dt"


def write_batch(df: DataFrame, batch_id: int, path: str, source: str, run: str, time: str | None = None,
                by: Sequence[str] = ()) -> None:
    """Replaces the folder of one batch of one query, by day if rows have a ``time``."""
    folder = f"{path}/{SOURCE}={source}/{RUN}={run}/{BATCH}={batch_id}"
    rows, parts = (with_day(df, time, DAY), [*by, DAY]) if time else (df, list(by))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*parts) if parts else writer).parquet(folder)


def read_batches(spark: SparkSession, path: str, target: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """All batches of all streams as one table with its day column; of one ``target`` if they were split.

    ``schema`` (of the columns stored in the files) lets a table be read that no batch has written a row to.
    """
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if schema and not set(rows.columns) & {SOURCE, RUN, BATCH}:  # no folder below it yet
        return rows.withColumn(DAY, F.lit(None).cast("date"))
    if target is not None:
        rows = rows.filter(F.col(TARGET) == target)
    return rows.drop(SOURCE, RUN, BATCH, TARGET)


def compact_batches(spark: SparkSession, path: str, to: str, days: Sequence[date], target: str | None = None,
                    time: str = "timestamp", sort: Sequence[str] = ("request_host",)) -> None:
    """Rewrites the small files of some days as a fact table, to another place.

    Only these days are read and replaced there, so a run is as large as the
    days it is given and may be repeated, also when late rows came.
    """
    rows = read_batches(spark, path, target).filter(F.col(DAY).isin(list(days))).drop(DAY)
    write_facts(rows, to, time=time, sort=sort, mode="overwrite", only_days=True)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint gives its query for as long as the checkpoint lives."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _start(stream: DataFrame, handler: Callable[[DataFrame, int, str], None], checkpoint: str,
           once: bool, every: str) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        handler(batch, batch_id, _query_id(batch.sparkSession, checkpoint))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


Rates = Mapping[str, int] | Callable[[], Mapping[str, int]]


def routed(rows: DataFrame, rules: Mapping[str, Column], rates: Mapping[str, int] | None = None, key: Column | None = None,
           weight: str = "weight") -> DataFrame:
    """Every row once for each target that takes it, with ``target``.

    ``rates`` thins targets out each for itself: one in so many rows stays, by
    the hash ``key`` (any well-spread integer), and ``weight`` says how many it
    stands for; targets without a rate keep all their rows at a weight of one.
    A row's targets and weights are decided together, in one pass.
    """
    if rates is None:
        met = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda t: t.isNotNull())
        return rows.withColumn(TARGET, F.explode(met))
    unknown, wrong = set(rates) - set(rules), [n for n, r in rates.items() if r < 1]
    if unknown or wrong:
        raise ValueError(f"rates of unknown targets or below one: {sorted(unknown | set(wrong))}")
    hashed = rows.withColumn("_key", sample_hash() if key is None else key)
    takes = [F.when(rule & (F.pmod(F.col("_key"), F.lit(rates.get(name, 1))) == 0),
                    F.struct(F.lit(name).alias(TARGET), F.lit(rates.get(name, 1)).cast("long").alias("_weight"))) for name, rule in rules.items()]
    met = hashed.withColumn("_taken", F.explode(F.filter(F.array(*takes), lambda t: t.isNotNull())))
    return met.withColumns({TARGET: F.col(f"_taken.{TARGET}"), weight: F.col("_taken._weight")}).drop("_key", "_taken")


def start_ingest(stream: DataFrame, normalise: Callable[[DataFrame], DataFrame], path: str,
                 rules: Mapping[str, Column], checkpoint: str, source: str, rollup_of: str | None = None,
                 rollup_path: str | None = None, table: LogTable | None = None,
                 facets: Mapping[str, str] | None = None, once: bool = True,
                 every: str = "1 minute", time: str = "timestamp", rates: Rates | None = None,
                 key: Column | None = None) -> StreamingQuery:
    """Normalise, split by rule into targets, thin these out, and add the roll-up partials of one.

    ``source`` names the stream for good. A batch is written in one pass: every
    row once for each target that takes it, in that target's folders (see
    ``routed``; ``rates`` may be a function, which every batch asks anew). The
    roll-up reads the target just written; it needs no watermark because
    partials of any age simply add up. Batches without rows, or with none that a
    rule meets, leave empty folders.
    """
    def handle(batch: DataFrame, batch_id: int, run: str) -> None:
        now = rates() if callable(rates) else rates
        rows = routed(normalise(batch), rules, now, key)
        write_batch(rows, batch_id, path, source, run, time, [TARGET])
        if rollup_of and rollup_path:
            # The schema is known: a batch without rows has no file to take it from.
            stored = with_day(rows, time, DAY).schema
            folder = f"{path}/{SOURCE}={source}/{RUN}={run}/{BATCH}={batch_id}"
            kept = batch.sparkSession.read.schema(stored).parquet(folder).filter(F.col(TARGET) == rollup_of)
            write_batch(minute_rollup(kept, table, facets), batch_id, rollup_path, source, run, "minute")

    return _start(stream, handle, checkpoint, once, every)


def start_rollup(stream: DataFrame, table: LogTable, facets: Mapping[str, str], path: str, checkpoint: str,
                 source: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Roll-up partials per micro-batch; any lateness, re-summed on read."""
    def handle(batch: DataFrame, batch_id: int, run: str) -> None:
        write_batch(minute_rollup(batch, table, facets), batch_id, path, source, run, "minute")

    return _start(stream, handle, checkpoint, once, every)


def windowed_rollup(stream: DataFrame, table: LogTable, facets: Mapping[str, str],
                    lateness: timedelta) -> DataFrame:
    """The alternative with final rows only: tumbling minutes closed by a watermark."""
    counters = row_counters(table)
    pair = "struct<facet:string,dim:string>"
    pairs = F.array(*[F.struct(F.lit(n), F.coalesce(F.expr(d), F.lit(""))).cast(pair) for n, d in facets.items()])
    rows = (stream.withWatermark(table.time, f"{int(lateness.total_seconds())} seconds")
            .select(table.time, *[c.alias(n) for n, c in counters.items()], F.explode(pairs).alias("p")))
    return (rows.groupBy(F.window(table.time, "1 minute").alias("w"), "p.facet", "p.dim")
            .agg(*[F.sum(c).alias(c) for c in COUNTERS])
            .select(F.col("w.start").alias("minute"), "facet", "dim", *COUNTERS))


def start_versions(stream: DataFrame, path: str, checkpoint: str, source: str, once: bool = True,
                   every: str = "1 minute") -> StreamingQuery:
    """Append versioned rows as they come; readers take the latest per key."""
    return _start(stream, lambda batch, batch_id, run: write_batch(batch, batch_id, path, source, run), checkpoint, once, every)


def read_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return latest(df.drop(SOURCE, RUN, BATCH), keys, version)


def start_enriched(stream: DataFrame, names: Callable[[], DataFrame], key: str, path: str, checkpoint: str,
                   source: str, once: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Add dictionary names to rows; the dictionary is read anew for every batch.

    The names are joined by their measured size: small dictionaries broadcast,
    large ones shuffle. Rows without a name get an empty one.
    """
    def handle(batch: DataFrame, batch_id: int, run: str) -> None:
        joined = batch.join(names(), key, "left").withColumn("name", F.coalesce("name", F.lit("")))
        write_batch(joined, batch_id, path, source, run)

    return _start(stream, handle, checkpoint, once, every)
