"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once; the top bits of the hash choose one of
512 bins, and a bin keeps its smallest hash. Empty bins copy a bin found by a
hash of (bin, attempt), the same for all documents, at the first attempt that
meets a filled one (optimal densification). Four low-order bits of each bin are
packed into the fingerprint. Two fingerprints agree in a bin by chance with
probability 1/16, which the estimate of likeness corrects for.

Words are parted by white space, letters A-Z count as a-z. Fewer than five words
are one shingle of all of them.

Defined cases: NULL, empty and blank texts have the empty fingerprint; two empty
fingerprints are alike (1), an empty and another are not (0); equal texts have
equal fingerprints; the order of documents with one id follows a hash of their
texts, NULL ids come first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import id_ranges, map_batches, partitions, range_of
from tidegauge.llm.simhash import shingle_hashes

WIDTH = 5
BINS_LOG2 = 9
BINS = 1 << BINS_LOG2
BITS = 4
#: Attempts held as a table; a bin that meets no filled one within them takes the next filled bin in order.
ATTEMPTS = 2048
FIRST = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a well-known 64-bit generator (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _attempts() -> np.ndarray:
    at = np.arange(ATTEMPTS * BINS, dtype=np.uint64).reshape(ATTEMPTS, BINS)
    return (_mixed(at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS_LOG2)).astype(np.int16)


def bins(hashes: np.ndarray) -> np.ndarray:
    """Low-order bits of all bins (empty for no hashes)."""
    if not hashes.size:
        return np.empty(0, np.uint8)
    least = np.sort(hashes)
    of = (least >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    out, filled = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    out[of[first]] = (least[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    filled[of[first]] = True
    source, empty, at = np.arange(BINS), np.flatnonzero(~filled), 0
    table = _attempts()
    while empty.size and at < ATTEMPTS:
        step = 16 if at == 0 else 128
        tried = table[at:at + step][:, empty]
        hit = filled[tried]
        met = hit.any(axis=0)
        source[empty[met]] = tried[hit[:, met].argmax(axis=0), np.flatnonzero(met)]
        empty, at = empty[~met], at + step
    if empty.size:
        there = np.flatnonzero(filled)
        source[empty] = there[np.searchsorted(there, empty) % there.size]
    return out[source]


def fingerprint(text: str | None) -> np.ndarray:
    return bins(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), WIDTH))


def packed(low: np.ndarray) -> str:
    """Two bins a byte, in hexadecimal digits."""
    return (low[::2] << BITS | low[1::2]).astype(np.uint8).tobytes().hex()


def unpacked(text: str) -> np.ndarray:
    both = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([both >> BITS, both & ((1 << BITS) - 1)], axis=1).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles from 0 to 1, corrected for bins that agree by chance."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    chance = 1 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of ``following``."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row."""
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(fingerprint(t)) for t in batch.column(1).to_pylist()], pa.string())],
                                              ["doc_id", "fingerprint"])
        return one
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       "doc_id long, fingerprint string", make)


def neighbours(docs: DataFrame) -> DataFrame:
    """Partitions in which every document is followed by the next one, ascending by id, after the last the first.

    Columns ``part``, ``ahead``, ``doc_id``, ``text``. Documents are dealt into
    ranges of ids; the first of a range goes to the range before it as well,
    marked ``ahead``. The bounds and first ids come from the ids alone.
    """
    n = partitions(docs.sparkSession)
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    ids = docs.select(at.alias("at"))
    part = range_of("at", id_ranges(ids, "at", n))
    firsts = sorted(tuple(r) for r in ids.groupBy(part.alias("part")).agg(F.min("at").alias("first")).collect())  # one row per range
    rows = docs.select(at.alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", part).withColumn("key", F.xxhash64("text"))
    before = [(p, first, firsts[i - 1][0]) for i, (p, first) in enumerate(firsts)]
    if not before:
        return rows.select("part", F.lit(False).alias("ahead"), "doc_id", "text")
    previous = F.create_map(*[F.lit(x) for p, _, q in before for x in (p, q)])
    first = F.create_map(*[F.lit(x) for p, f, _ in before for x in (p, f)])
    own = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    copy = F.struct(previous[F.col("part")].alias("part"), F.lit(True).alias("ahead"))
    dealt = rows.select(F.explode(F.when(first[F.col("part")] == F.col("at"), F.array(own, copy)).otherwise(F.array(own))).alias("to"), "at", "key", "doc_id", "text")
    return (dealt.select("to.part", "to.ahead", "at", "key", "doc_id", "text").repartitionById(n, "part")
            .sortWithinPartitions("part", "ahead", "at", "key").select("part", "ahead", "doc_id", "text"))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike it is to that and to the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, ahead, doc_id, text and bins of the row whose successor comes next
        for batch in batches:
            out: list[tuple] = []
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = fingerprint(text)
                if last is not None and last[0] == part and not last[1]:
                    new = edited(last[3], text)
                    new_low = fingerprint(new)
                    out.append((last[2], len(last[3]), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), packed(last[4]),
                                packed(new_low), likeness(last[4], new_low), likeness(last[4], low)))
                last = (part, ahead, doc_id, text, low)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
    return neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
