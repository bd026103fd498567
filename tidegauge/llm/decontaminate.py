"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document may be long, so the likeness of the two sets
of shingles says little. Items are therefore partitioned by their number of
shingles into classes (1, 2, 3 to 4, …, 17 to 32, …), and for each class a document
is seen as overlapping windows of twice the class's upper bound, one bound apart.
A passage of that class lies within one window, whose likeness to the item is at
least 0.19 where 0.8 of the item is contained. Of 64 minimum hashes, each a band
of its own, all miss such a window with a probability below 2e-6.

Bands of windows are compared with those of the items through a bitmap of fixed
size before anything is shuffled; what passes is joined by equality and verified
by exact containment of the item's shingles in the whole document.

Shingles are runs of five words (lower case, words parted by white space); an
item of fewer words is a shingle of all of them and must occur as it stands.

Defined cases: NULL, empty and blank texts match nothing, neither do items
without a word; documents that share an id are judged each on their own and
reported once with their highest share; NULL ids are kept; empty tables give no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, partitions, same, written
from tidegauge.llm.simhash import shingle_hashes

WIDTH = 5
CONTAINED = 0.8
BANDS = 64
#: Bits of the map of item bands: 4 MB, whatever the number of items.
MAP_BITS = 1 << 25
#: Shingles hashed at once, so that a band's values stay in the cache.
BLOCK = 1 << 18
NONE = np.uint32(0xFFFFFFFF)


def band_factors(bands: int = BANDS) -> np.ndarray:
    """Odd 32-bit factors: the fractional parts of multiples of the golden ratio."""
    return np.asarray([((j + 1) * 0x9E3779B97F4A7C15 >> 17) & 0xFFFFFFFF | 1 for j in range(bands)], np.uint32)


def mixed(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)


def class_of(n: int) -> int:
    """Exponent of the class's upper bound."""
    return math.ceil(math.log2(n))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where a lambda inside uses it."""
    return F.transform(F.array(value), then)[0]


def shingles(text: Column, width: Column | int = WIDTH) -> Column:
    """Distinct runs of ``width`` words (none where there are fewer)."""
    return _let(words(text), lambda found: F.when(F.size(found) >= width, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(found) - width + 1), lambda i: F.array_join(F.slice(found, i, width), " "))))
        .otherwise(F.array().cast("array<string>")))


def _items(benchmark: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    sized = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.least(F.size(words(text)), F.lit(WIDTH)).alias("width"))
    return sized.where("width > 0").withColumn("shingles", shingles(F.col("text"), F.col("width")))


def _key(width, kind, band, value):
    """A band of one class as one number: width, class and band above the 32 bits of its value."""
    return ((width * 64 + kind) * BANDS + band) << 32 | value


def _item_bands(items: DataFrame) -> DataFrame:
    factors = band_factors()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys = [], []
            for item, text, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = mixed(np.unique(shingle_hashes(text.lower().encode("utf-8", "surrogatepass"), width)))
                least = (hashes[:, None] * factors).min(axis=0)
                ids += [item] * BANDS
                keys += [_key(width, class_of(hashes.size), j, int(v)) for j, v in enumerate(least)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["item_id", "key"])
        return one
    return map_batches(items.select("item_id", "text", "width"), "item_id long, key long", make)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 25)).astype(np.int64)


def _bitmap(bands: DataFrame) -> np.ndarray:
    """Bits of all item bands, gathered as at most ``MAP_BITS / 64`` words."""
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            slots = np.unique(_slot(batch.column(0).to_numpy()))
            return pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.left_shift(np.int64(1), slots & 63))], ["at", "bits"])
        return one
    words_ = map_batches(bands.select("key"), "at long, bits long", make).groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(MAP_BITS // 64, np.int64)
    for r in words_:
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if words_ else np.zeros(0, bool)


def _window_keys(hashes: np.ndarray, block_doc: np.ndarray, width: int, base: int, kinds: list[int], factors: np.ndarray,
                 bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and bands that the bitmap lets pass. ``hashes``: one column per block of ``2 ** base`` shingles."""
    docs, keys, buffer, filler = [], [], np.empty_like(hashes), hashes == NONE
    for j, factor in enumerate(factors):
        np.multiply(hashes, factor, out=buffer)
        np.copyto(buffer, NONE, where=filler)
        least, owner = buffer.min(axis=0), block_doc
        for kind in range(base, kinds[-1] + 1):
            if kind > base:  # every document has a whole number of the largest blocks
                least, owner = np.minimum(least[::2], least[1::2]), owner[::2]
            if kind not in kinds:
                continue
            window = least.copy()
            joined = owner[1:] == owner[:-1]
            np.minimum(window[:-1], least[1:], out=window[:-1], where=joined)
            key = window.astype(np.int64) | (((width * 64 + kind) * BANDS + j) << 32)
            hit = np.flatnonzero(bitmap[_slot(key)] & (window != NONE))
            docs.append(owner[hit])
            keys.append(key[hit])
    return np.concatenate(docs), np.concatenate(keys)


def _candidate_bands(docs: DataFrame, kinds: dict[int, list[int]], bitmap: np.ndarray) -> DataFrame:
    """``doc_id``, ``key`` of window bands that may be an item's. ``kinds``: the classes of each shingle width."""
    shared, factors = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap)), band_factors()

    def make():
        bits = np.unpackbits(shared.value).view(bool)

        def some(texts: list[bytes], first: int, width: int, own: list[int]) -> tuple[np.ndarray, np.ndarray]:
            base, whole = own[0], 1 << own[-1]
            parts, owners = [], []
            for i, text in enumerate(texts, first):
                hashes = mixed(shingle_hashes(text, width))
                if hashes.size:
                    hashes[hashes == NONE] = 0
                    size = -(-hashes.size // whole) * whole
                    parts.append(np.concatenate([hashes, np.full(size - hashes.size, NONE)]))
                    owners.append(np.full(size >> base, i))
            if not parts:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            blocks = np.ascontiguousarray(np.concatenate(parts).reshape(-1, 1 << base).T)
            return _window_keys(blocks, np.concatenate(owners), width, base, own, factors, bits)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            found, size, at = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text) // 4
                if size >= BLOCK or i == len(texts) - 1:
                    found += [some(texts[at:i + 1], at, width, own) for width, own in kinds.items()]
                    size, at = 0, i + 1
            rows, keys = (np.concatenate(c) for c in zip(*found, strict=True))
            pairs = np.unique(np.stack([rows, keys]), axis=1)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0])), pa.array(pairs[1])], ["doc_id", "key"])
        return one
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, key long", make)


def contaminated(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """``doc_id``, ``item_id``, ``containment`` (share of the item's shingles in the document) from ``contained`` up."""
    items = written(_items(benchmark), "items")
    bands = written(_item_bands(items), "bands")
    # A handful of numbers: widths times powers of two.
    kinds: dict[int, list[int]] = {}
    for r in bands.select(F.shiftright("key", 32 + 6).alias("k")).distinct().orderBy("k").collect():
        kinds.setdefault(r["k"] // 64, []).append(r["k"] % 64)
    if not kinds:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("item_id"),
                           F.lit(None).cast("double").alias("containment")).where("false")
    met = _candidate_bands(docs, kinds, _bitmap(bands)).join(bands, "key").select("doc_id", "item_id").distinct()
    candidates = written(met.repartition(partitions(docs.sparkSession)), "candidates")
    asked = candidates.join(items.select("item_id", "width", "shingles"), "item_id").select(F.col("doc_id").alias("_id"), "item_id", "width", "shingles")
    # Written, so that a few ids travel to the texts instead of all texts to the ids.
    wanted = written(candidates.select(F.col("doc_id").alias("_wanted")).distinct(), "wanted")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = whole.join(wanted, same(whole["doc_id"], wanted["_wanted"]), "left_semi")
    share = F.size(F.array_intersect(shingles(F.col("text"), F.col("width")), "shingles")) / F.size("shingles")
    return (text.join(asked, same(text["doc_id"], asked["_id"])).select("doc_id", "item_id", share.alias("containment"))
            .groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
            .where(F.col("containment") >= contained))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document contains no benchmark item."""
    found = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(found, same(docs["doc_id"], found["_bad"]), "left_anti")
