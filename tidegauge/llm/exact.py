"""Exact deduplication by 128-bit content hashes, with the bytes compared inside groups.

Documents are grouped by the MD5 of their text, 16 bytes, in rows that carry no
text. Only where a hash occurs more than once are bytes compared: the texts of
such hashes are grouped by hash and text, which combines equal texts within each
map task, so a text that a third of all rows share is one row per task in the
shuffle. A hash under which two texts meet is a collision; its rows are grouped
by their text instead.

Everything runs on built-in functions. Which hashes repeat is written before the
texts are read again: up to ``BROADCAST`` of them (24 MB) travel to the texts, so
texts without copies are not moved; with more, all texts are shuffled once.
Rows find their group by an equi-join on the hash that adaptive execution can
split, as both sides are written tables.

Defined cases: a NULL text equals an empty one; rows that repeat an id are
grouped by their texts like others; of equal texts the row with the largest (or
smallest) id stays, and where several rows have that id just one of them; NULL
ids stay only where a group has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import same, written

#: Repeated hashes that are sent to all tasks; 24 bytes each.
BROADCAST = 1_000_000
#: What a NULL id counts as when the id that stays is chosen: the last choice.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def content_hash(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def _groups(rows: DataFrame, key: str, keep: str) -> DataFrame:
    """Per ``key``: ``n`` rows, the id that stays and the number of its row."""
    largest = keep == "largest"
    id_ = F.coalesce(F.col("doc_id"), F.lit(LEAST if largest else MOST))
    extreme, by = (F.max, F.max_by) if largest else (F.min, F.min_by)
    return rows.groupBy(key).agg(F.count("*").alias("n"), extreme("doc_id").alias("keep_id"), by("row", id_).alias("keep_row"))


def _colliding(texts: DataFrame, shared: DataFrame, groups: int) -> DataFrame:
    """Hashes of ``shared`` under which different texts meet."""
    if groups <= BROADCAST:
        texts = texts.join(F.broadcast(shared), "hash", "left_semi")
    return texts.select("hash", "text").distinct().groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")


def _decided(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows with their group; rows whose key ``groups`` lacks are alone."""
    found = rows.join(groups.withColumnRenamed(key, "_key").hint("merge"), F.col(key) == F.col("_key"), "left")
    alone = F.col("_key").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "row")


def _numbered(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("hash"))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``: one row per row of ``docs``.

    ``keep``: ``smallest`` or ``largest`` id of a group. ``digest`` may be any
    hash of a text; a weak one costs comparisons, never a result.
    """
    texts = _numbered(docs, digest)
    rows = written(texts.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "hashes")
    groups = written(_groups(rows, "hash", keep).where("n > 1"), "groups")
    shared = groups.select("hash")
    colliding = written(_colliding(texts, shared, groups.count()), "colliding")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if colliding.isEmpty():
        return _decided(rows, groups, "hash").select(columns)
    apart = written(texts.join(colliding, "hash", "left_semi")
                    .select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "apart")
    by_text = _groups(apart, "text", keep).where("n > 1")
    rest = rows.join(colliding, "hash", "left_anti")
    return (_decided(rest, groups, "hash").select(columns)
            .union(_decided(apart, written(by_text, "groups"), "text").select(columns)))


def without_duplicates(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each group of equal texts.

    Rows of a group that agree in the id that stays are cut to one.
    """
    found = exact_duplicates(docs, keep, digest).where("kept")
    stay = written(found.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "stay")
    text = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    met = docs.join(stay, same(docs["doc_id"].cast("long"), stay["_id"]) & (text == stay["_sha"]), "left_semi")
    # Only an id that a text has twice needs its rows told apart.
    twice = (met.groupBy(F.col("doc_id").alias("_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("_sha"))
             .agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_sha"))
    twice = written(twice, "twice")
    if twice.isEmpty():
        return met
    again = same(met["doc_id"], twice["_id"]) & (F.sha2(F.coalesce(met["text"].cast("string"), F.lit("")), 256) == twice["_sha"])
    return met.join(twice, again, "left_anti").union(met.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))
