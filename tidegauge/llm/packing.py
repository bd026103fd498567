"""Sequence packing by non-negative least squares over a length histogram.

Documents are cut at full windows; what is left of each is a piece shorter than
the window. Lengths are counted in classes of eight tokens. All combinations of
up to three classes that fill a window exactly are columns of a matrix, and
non-negative least squares finds how often to use each so that the counts of the
classes are met. The counts are rounded down; the classes left over are packed
greedily, largest first, into recipes of their own. All of this happens on the
histogram, whose size is fixed, so it costs the same for any number of documents.

The pieces are then numbered within their class, and a piece's number alone
tells its sequence and place: no task sees more than one sequence.

Defined cases: NULL and empty texts are one piece that holds the end id; rows
that repeat an id are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import gapless, map_batches, partitions, written
from tidegauge.llm.tokens import encoder, groups, id_lists

WINDOW = 2048
#: Tokens of a length class: what a piece may lack to the end of its class is padding.
GRAIN = 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, spaced: bool, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Rows of ``PIECES`` (and ``ids``): whole texts with the end id, cut after each full window."""
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        coder = encoder(vocabulary, spaced)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [raw + end for group in groups(batch.column(1).to_pylist()) for raw in coder.encode(group)]
            sizes = np.asarray([len(raw) // 4 for raw in found], np.int64)
            rows = np.repeat(np.arange(sizes.size), -(-sizes // window))
            parts = [raw[at:at + 4 * window] for raw in found for at in range(0, len(raw), 4 * window)]
            lengths = np.asarray([len(p) // 4 for p in parts], np.int64)
            nth = np.arange(rows.size) - np.searchsorted(rows, rows)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(nth * window), pa.array(lengths),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(sizes[rows])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, id_lists(parts)], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)
        return one
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, PIECES + (", ids array<int>" if with_ids else ""), make)


def combinations(classes: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Class multisets of up to ``depth`` (at most three) that add up to ``classes``."""
    found: list[tuple[int, ...]] = [(classes,)]
    if depth > 1:
        found += [(a, classes - a) for a in range((classes + 1) // 2, classes)]
    if depth > 2:
        found += [(a, b, classes - a - b) for a in range(-(-classes // 3), classes - 1)
                  for b in range(-(-(classes - a) // 2), min(a, classes - a - 1) + 1)]
    return found


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative least squares by an active set: columns enter one by one, leave when they turn negative."""
    x, at, gram = np.zeros(matrix.shape[1]), np.empty(0, int), np.empty((0, 0))
    aim = matrix.T @ target
    tolerance = 1e-7 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gain = aim - matrix.T @ (matrix @ x)
        gain[at] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        cross = matrix[:, at].T @ matrix[:, best]
        # The tiny ridge keeps columns that depend on each other solvable.
        gram = np.block([[gram, cross[:, None]], [cross[None], np.full((1, 1), matrix[:, best] @ matrix[:, best] + 1e-9)]])
        at = np.append(at, best)
        while True:
            y = np.linalg.solve(gram, aim[at])
            low = y <= 0
            if not low.any():
                break
            old = x[at]
            step = float((old[low] / (old[low] - y[low] + 1e-300)).min())
            old += step * (y - old)
            stay = ~((old <= tolerance) & low)
            x[at] = 0
            at, gram = at[stay], gram[np.ix_(stay, stay)]
            x[at] = old[stay]
        x[at] = y
    return x


def recipes(histogram: np.ndarray, depth: int = 3) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, classes) that use every counted piece once; ``histogram[c]`` pieces of class c, 1 to the last."""
    classes = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(kinds: tuple[int, ...], most: int | None = None) -> None:
        need = np.bincount(kinds, minlength=classes + 1)
        at = np.flatnonzero(need)
        repeats = int((left[at] // need[at]).min())
        repeats = repeats if most is None else min(repeats, most)
        if repeats > 0:
            left[at] -= repeats * need[at]
            out.append((repeats, kinds))

    take((classes,))
    kinds = [k for k in combinations(classes, depth)[1:] if all(left[c] for c in k)]
    if kinds:
        matrix = np.zeros((classes, len(kinds)))
        for j, k in enumerate(kinds):
            for c in k:
                matrix[c, j] += 1
        counts = nnls(matrix, left[:classes].astype(float), 3 * classes)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] < 1:
                break
            take(kinds[j], int(counts[j]))
    while left.any():
        room, kinds = classes, []
        rest = left.copy()
        while room and rest[1:room + 1].any():
            c = int(np.flatnonzero(rest[1:room + 1])[-1]) + 1
            n = min(int(rest[c]), room // c)
            kinds += [c] * n
            rest[c] -= n
            room -= n * c
        take(tuple(kinds))
    return out


def plan(histogram: np.ndarray) -> dict[str, np.ndarray]:
    """Per class, which numbers of its pieces go to which sequences: arrays sorted by (class, first number)."""
    rows, used, sequence = [], np.zeros(len(histogram), np.int64), 0
    for repeats, kinds in recipes(histogram):
        place = 0
        for c in sorted(set(kinds), reverse=True):
            each = kinds.count(c)
            rows.append((c, used[c], sequence, each, place))
            used[c] += repeats * each
            place += each
        sequence += repeats
    rows.sort()
    names = ("kind", "first", "sequence", "each", "place")
    return {n: np.asarray([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(cut: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written ``pieces``; ``cut`` is read more than once."""
    kind = F.ceil(F.col("length") / grain).cast("int")
    counts = cut.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()  # one row per class
    histogram = np.zeros(-(-window // grain) + 1, np.int64)
    for r in counts:
        histogram[r["kind"]] = r["n"]
    where = plan(histogram)
    span = int(histogram.max()) + 1
    numbered = gapless(cut.withColumn("kind", kind), ["kind"], ["doc_id", "start", "ids_crc32", "length"], "nth", 4 * partitions(cut.sparkSession))
    columns = cut.columns

    def make():
        keys = where["kind"] * span + where["first"]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, nth = (batch.column(i).to_numpy().astype(np.int64) for i in (len(columns), len(columns) + 1))
            row = np.searchsorted(keys, kinds * span + nth, side="right") - 1
            inside = nth - where["first"][row]
            sequence = where["sequence"][row] + inside // where["each"][row]
            place = where["place"][row] + inside % where["each"][row]
            return pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(sequence), pa.array(place)],
                                              [*columns, "sequence_id", "place"])
        return one
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, place long"
    placed = map_batches(numbered.select(*columns, "kind", "nth"), schema, make)
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place")


def sequences(packed: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """``sequence_id``, ``n_tokens``, ``doc_ids``, ``offsets``, ``ids`` padded to the window.

    A sequence whose length is a power of two stays as it is. Takes pieces with ``ids``.
    """
    found = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"),
                                              F.sum("length").alias("n_tokens"))
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(window) - F.col("n_tokens")).cast("int")
    return found.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"),
                        F.concat(F.flatten("p.ids"), F.array_repeat(F.lit(pad_id), missing)).alias("ids"))


def packed(docs: DataFrame, vocabulary: str, spaced: bool, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(written(pieces(docs, vocabulary, spaced, end_id, window), "pieces"), window)
