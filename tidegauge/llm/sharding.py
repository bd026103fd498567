"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

Documents with equal texts form a group and stay together. A group above a fixed
fraction of a shard is placed by itself; all smaller ones are dealt into a fixed
number of bundles by a hash. Only these are packed, so what reaches the driver
is bounded by the number of shards, whatever the number of documents. A group
heavier than a whole shard cannot stay in one and is cut into equal parts.

Packing: heaviest first, each goes to the shard where the dot product of its
load with the residual capacity is highest, among the shards it fits in.

Defined cases: a NULL text has no bytes and no tokens and forms a group of its
own; rows that repeat an id are rows like any other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import gapless, partitions, written

#: Bundles of small groups per shard; a group above one bundle's share is placed by itself.
BUNDLES = 256
#: Bytes every document takes besides its text.
HEADER = 8


def loads(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``grp``, ``size``, ``tokens`` (runs of non-blank characters), ``text_crc32``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("grp"),
        (F.octet_length(text) + HEADER).cast("long").alias("size"),
        F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long").alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def _sums() -> list:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]


def place(load: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``load`` (n, dimensions)."""
    total = load.sum(axis=0, dtype=float)
    share = load / np.where(total > 0, total / shards, 1)
    room, out = np.ones((shards, load.shape[1])), np.zeros(len(load), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        score = room @ share[i]
        fits = (room >= share[i]).all(axis=1)
        best = int(np.where(fits, score, -np.inf).argmax()) if fits.any() else int(score.argmax())
        out[i] = best
        room[best] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 24, bundles: int = BUNDLES) -> DataFrame:
    """``doc_id``, ``size``, ``tokens``, ``text_crc32``, ``shard``, ``slot`` (gapless within the shard)."""
    spark = docs.sparkSession
    rows = written(loads(docs), "loads")
    groups = written(rows.groupBy("grp").agg(*_sums()), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    part = F.greatest(*[F.col(c) / F.lit(float(max(total[c] or 0, 1)) / shards) for c in ("bytes", "tokens", "n")])
    # Of each dimension at most shards * bundles groups can exceed a bundle's share: small enough to broadcast.
    large = groups.where(part > 1 / bundles).select("grp", F.ceil(F.col("bytes") * shards / F.lit(float(max(total["bytes"] or 0, 1)))).alias("cuts"))
    cut = F.pmod(F.xxhash64("doc_id", "grp"), F.col("cuts"))
    small = F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(shards * bundles))
    held = rows.join(F.broadcast(large), "grp", "left").select(
        *rows.columns, F.when(F.col("cuts").isNull(), small).otherwise(-1 - cut).alias("bundle"),
        F.when(F.col("cuts").isNotNull(), F.col("grp")).alias("alone"))
    loaded = held.groupBy("bundle", "alone").agg(*_sums()).orderBy("bundle", "alone").collect()  # bounded as above
    at = place(np.asarray([[r["bytes"], r["tokens"], r["n"]] for r in loaded], float).reshape(-1, 3), shards)
    where = spark.createDataFrame(
        [(r["bundle"], r["alone"], int(s)) for r, s in zip(loaded, at, strict=True)], "bundle long, alone long, shard int")
    placed = (held.join(F.broadcast(where.withColumnsRenamed({"bundle": "_b", "alone": "_a"})),
                        (F.col("bundle") == F.col("_b")) & F.col("alone").eqNullSafe(F.col("_a")))
              .select("doc_id", "grp", "size", "tokens", "text_crc32", "shard"))
    return gapless(placed, ["shard"], ["doc_id", "grp"], "slot", 4 * partitions(spark)).drop("grp")
