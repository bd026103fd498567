"""SimHash near-duplicates found through deletion variants of fingerprint halves.

Two 64-bit fingerprints that differ in at most two bits differ in at most one
bit within one of their two halves. Each half is therefore indexed 32 times,
once with each of its bits left out: such a pair meets under an equal variant,
and equality joins find it without comparing everything with everything.

Variants under which more than two fingerprints meet are refined by variants of
the other half. What then shares a key differs in two bits at most, by
construction, and at most 33 different fingerprints can share one, so a crowd of
any size costs a fixed number of rows per member instead of all its pairs.

Defined cases: NULL, empty and blank texts have fingerprint zero; repeated rows
and equal texts share a fingerprint; NULL ids are kept, and a component's id is
its smallest id that is not NULL (NULL if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, map_batches, partitions, same, written
from tidegauge.llm.components import components

SHINGLE_WORDS = 3
#: Seed of the shingle hash.
SEED = 42
#: Shingles whose bits are counted at once, to bound memory on very long texts.
BLOCK = 1 << 16
HALF = 0xFFFFFFFF


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by one space (fewer words: of all of them)."""
    words = WORD.findall(text)
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    line = b" ".join(words)
    n = max(len(words) - width + 1, 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def simhash(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint as a signed 64-bit integer: bits set in over half the shingle hashes."""
    hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), width)
    if not hashes.size:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, hashes.size, BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((counts * 2 > hashes.size).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (signed 64-bit) of every row; other columns are left behind."""
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [simhash(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        return one
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, "doc_id long, fp long", make)


def _variants(fps: DataFrame) -> DataFrame:
    """``fp``, ``other`` half and the ``key`` of each half with one bit left out.

    A key holds the number of the half and of the bit above the half's 32 bits.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("fp", 32)

    def keys(half: int, value):
        return [F.lit((half * 32 + bit) << 32).bitwiseOR(value.bitwiseAND(F.lit(HALF ^ (1 << bit)))) for bit in range(32)]
    return fps.select("fp", F.explode(F.array(*keys(0, low), *keys(1, high))).alias("key"))


def _refined(crowded: DataFrame) -> DataFrame:
    """Pairs among fingerprints that share a crowded variant.

    ``sub`` is the other half with one bit left out: sharing it and the variant
    means two differing bits at most. Equal halves may be followed by two
    differing bits in the other half; these pairs meet at a value one bit away
    from both, and looking for them under the variants of bit 0 is enough.
    """
    second = F.shiftrightunsigned("key", 37) == 1
    own = F.when(second, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(HALF)))
    other = F.when(second, F.col("fp").bitwiseAND(F.lit(HALF))).otherwise(F.shiftrightunsigned("fp", 32))
    rows = crowded.select("fp", "key", own.alias("own"), other.alias("other"))
    one_out = [F.lit((1 + bit) << 32).bitwiseOR(F.col("other").bitwiseAND(F.lit(HALF ^ (1 << bit)))) for bit in range(32)]
    side = F.shiftleft(F.col("own").bitwiseAND(F.lit(1)) + 64, 32)
    near = [side.bitwiseOR(F.col("other")), *[side.bitwiseOR(F.col("other").bitwiseXOR(F.lit(1 << bit))) for bit in range(32)]]
    first_bit = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(31)) == 0
    subs = F.when(first_bit, F.array(*one_out, *near)).otherwise(F.array(*one_out))
    met = (rows.select("fp", "key", F.explode(subs).alias("sub")).groupBy("key", "sub")
           .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))  # 33 at most
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly what fingerprints at two or fewer differing bits connect.

    ``fps`` holds each fingerprint once. They are dealt out evenly before each
    becomes 64 rows: as they are, they may lie in a few small partitions.
    """
    variants = _variants(fps.repartition(partitions(fps.sparkSession)))
    met = written(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                  .where("n > 1"), "variants")
    pairs = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    # Merged at every size: how many variants are crowded follows the copies in the data.
    crowded = variants.join(met.where("n > 2").select("key").hint("merge"), "key", "left_semi")
    return pairs.union(_refined(crowded)).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest id reachable over links) of every row."""
    rows = written(fingerprints(docs, id_column, text_column), "simhash")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(rows.select("fp").distinct()))
    placed = (least.join(roots, least["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the document with the smallest id stays.

    Rows equal in id and text stay once. Different texts under one id count as
    one document and stay together. NULL ids stay only where their component
    has no other id.
    """
    found = written(near_duplicates(docs), "classes")
    stay = found.where(same(F.col("doc_id"), F.col("component_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    stay = written(stay, "stay")
    once, again = (stay.where(c).select("_id") for c in ("_n = 1", "_n > 1"))
    kept = docs.join(once, same(docs["doc_id"], once["_id"]), "left_semi")
    return kept.union(docs.join(again, same(docs["doc_id"], again["_id"]), "left_semi").dropDuplicates(["doc_id", "text"]))
