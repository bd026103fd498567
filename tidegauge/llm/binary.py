"""Token ids in ORC files.

A file holds a contiguous range of document ids in ascending order. ORC encodes
ids and counters as integer runs, keeps minimum and maximum of every row group
in its row index and a Bloom filter of the document ids beside it: readers split
a file by stripes, and a look-up by id skips stripes and row groups.

Columns of the files: ``part`` (number of the file in id order), ``doc_id``,
``start`` (ids before the document within the file), ``n_tokens``, ``ids``.

Defined cases: a NULL text is an empty one and holds the end id alone; NULL ids
come first; documents that share an id are each written, one after the other;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, partitions
from tidegauge.llm.tokens import encoder, groups, id_lists

#: Bytes of a stripe, the unit of parallel reads, and rows of a row group, the unit of skipping.
STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000
SCHEMA = "part int, doc_id long, start long, n_tokens int, ids array<int>"


def write_ids(docs: DataFrame, path: str, vocabulary: str, spaced: bool, end_id: int) -> None:
    """Encodes whole texts and writes them to a new folder ``path``, ascending by ``doc_id``.

    Texts, which are smaller than their ids, are what is shuffled. Hot ids are
    dealt out by a hash of the text as well.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    # Columns named doc_id and key keep every row of a range together and in order.
    dealt = (rows.withColumn("key", F.xxhash64("text")).repartitionByRange(n, "doc_id", "key")
             .sortWithinPartitions("doc_id", "key").select(F.spark_partition_id().alias("part"), "doc_id", "text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        coder, before = encoder(vocabulary, spaced), 0

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal before
            found = [raw + end for group in groups(batch.column(2).to_pylist()) for raw in coder.encode(group)]
            sizes = np.asarray([len(raw) // 4 for raw in found], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts), pa.array(sizes.astype(np.int32)), id_lists(found)],
                ["part", "doc_id", "start", "n_tokens", "ids"])
        return one
    (map_batches(dealt, SCHEMA, make).write.option("orc.compress", "ZSTD").option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.row.index.stride", str(ROW_GROUP)).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a folder: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``.

    The sizes of the files come from a pass over two columns of counters, one row per file.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    if not sizes:
        return files.select("doc_id", "start", "n_tokens", "ids")
    # An array by file number, so that the ids themselves are not moved by a join.
    first = np.zeros(sizes[-1][0] + 1, np.int64)
    first[[part for part, _ in sizes]] = starts[:-1]
    numbers = F.split(F.lit(",".join(map(str, first.tolist()))), ",")
    return files.select("doc_id", (F.element_at(numbers, F.col("part") + 1).cast("long") + F.col("start")).alias("start"), "n_tokens", "ids")


def find_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; stripes and row groups that cannot hold one are skipped."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_checksums(read: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` from the ids read."""
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)),
                                               pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        return one
    return map_batches(read.select("doc_id", "start", "ids"), "doc_id long, start long, n_tokens long, ids_crc32 long", make)
