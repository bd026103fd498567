"""Repeated passages by a sparse suffix array.

A suffix is kept where its first words hash lowest within a window of 32
positions (a minimiser): equal passages choose equal positions, one in sixteen
on average. Every passage of at least 50 words has such a position with 19 words
behind it, whose hash is the suffix's key; only suffixes whose key occurs in two
documents go on, with the words around them. These are sorted as a suffix array,
in ranges over all tasks, neighbours are compared, and a match is extended to
the right and to the left. It counts from 50 words up, and the matches of a
document are united to spans.

Neighbours share the longest run to the right, but another suffix may share more
to the left. The suffixes are therefore sorted a second time by the words before
them, read backwards, and compared with those neighbours too. The two orders tell
how much any other document can share on either side; windows of 50 words within
these bounds that no match covers are looked up by equality among all documents.

A word is a run of characters other than white space; spans count words. What
repeats within one document only is not a repeat. Contexts are compared by 32-bit
hashes of words.

Defined cases: NULL, empty and short texts have no passages; rows that repeat an
id count as one document; NULL ids are left out, as no span could name them;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, map_batches, partitions, written

MIN_WORDS = 50
#: Positions of a window, and words whose hash is compared in it.
WINDOW, GRAM = 32, 8
#: Words behind a minimiser that every long passage has, and those around it that can matter.
SURE = MIN_WORDS - WINDOW + 1
AROUND = WINDOW - 1
FACTOR = 0x9E3779B97F4A7C15
#: Sorted suffixes that are compared at once, about 300 bytes each.
CHUNK = 1 << 16
#: Windows searched at once; a position within them takes 24 bits.
BLOCK = 1 << 23
PLACE = np.uint64((1 << 24) - 1)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass"))
    return np.fromiter(map(digest, found), np.uint64, len(found))


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, put together from runs of powers of two."""
    out, done, power, size, factor = None, 0, words, 1, FACTOR
    n = max(words.size - width + 1, 0)
    while size <= width:
        if width & size:
            part = power[done:done + n]
            out = part if out is None else out * np.uint64(factor | 1) + part
            done += size
        if size * 2 <= width:
            power = power[:-size] * np.uint64(factor) + power[size:]
            factor = (factor * factor + 2) % (1 << 64)
        size *= 2
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions whose gram is the lowest, leftmost, of some window and that ``SURE`` words follow."""
    if words.size < MIN_WORDS:
        return np.empty(0, np.int64)
    values, found = grams(words, GRAM), []
    windows = values.size - WINDOW + 1
    for at in range(0, windows, BLOCK):
        part = values[at:min(at + BLOCK, windows) + WINDOW - 1]
        low, size = (part & ~PLACE) | np.arange(part.size, dtype=np.uint64), 1
        while size < WINDOW:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        found.append(np.unique(low & PLACE).astype(np.int64) + at)
    places = np.unique(np.concatenate(found))
    return places[places + SURE <= words.size]


def suffixes(docs: DataFrame) -> DataFrame:
    """``key``, ``doc_id``, ``place`` (word) of every suffix kept."""
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, rows, places = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = word_hashes(text)
                at = minimisers(words)
                if at.size:
                    keys.append(grams(words, SURE)[at])
                    rows.append(np.full(at.size, i))
                    places.append(at)
            if not keys:
                rows, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows))),
                                               pa.array(np.concatenate(places).astype(np.int32))], ["key", "doc_id", "place"])
        return one
    return map_batches(_rows(docs), "key long, doc_id long, place int", make)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Adds to each suffix the hashes of the words right of its key and, backwards, left of it, as sortable bytes."""
    def make():
        def around(words: np.ndarray, at: list[int]) -> tuple[list[bytes], list[bytes]]:
            short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # zero stands for the end of the text
            line = np.concatenate([np.zeros(AROUND, np.uint32), short, np.zeros(SURE + AROUND, np.uint32)]).astype(">u4")
            steps = np.asarray(at)[:, None] + AROUND
            right = line[steps + SURE + np.arange(AROUND)]
            left = line[steps - 1 - np.arange(AROUND)]
            return [r.tobytes() for r in right], [r.tobytes() for r in left]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, ids, places_, firsts, rights, lefts = [], [], [], [], [], []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes(text)
                found = [f for f in found if f["place"] + SURE <= words.size]
                if not found:  # another text under the same id
                    continue
                at = [f["place"] for f in found]
                right, left = around(words, at)
                keys += [f["key"] for f in found]
                firsts += [f["first"] for f in found]
                ids += [doc] * len(at)
                places_ += at
                rights += right
                lefts += left
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary()),
                                               pa.array(ids, pa.int64()), pa.array(places_, pa.int32()), pa.array(firsts, pa.int64())],
                                              ["key", "right", "left", "doc_id", "place", "first"])
        return one
    listed = places.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("key", "place", "first")).alias("found"))
    rows = _rows(docs)
    joined = rows.join(listed, rows["doc_id"] == listed["_id"]).select("doc_id", "text", "found")
    return map_batches(joined, "key long, right binary, left binary, doc_id long, place int, first long", make)


def _same_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns are equal and not past the end of a text."""
    return np.cumprod((a == b) & (a != 0), axis=1).sum(axis=1)


MATCHES = "key long, ctx long, doc_id long, place int, first long, most int, before int, behind int"


def _matches(table: pa.Table, side: int, begin: int, end: int) -> pa.RecordBatch:
    """Sorted suffixes (rows ``begin`` to ``end``; the others are their neighbours) with what they share with the nearest row of another document before and behind them.

    ``before`` and ``behind`` are ``left * (AROUND + 1) + right`` words of matches
    that are long enough, else -1; ``most`` is the largest number of words that
    any other document can share on the side sorted by (0: right, 1: left).
    Suffixes that can be in no match are left out.
    """
    n = table.num_rows
    key, doc, place = (table.column(c).to_numpy() for c in ("key", "doc_id", "place"))
    right, left = (np.frombuffer(b"".join(table.column(c).to_pylist()), ">u4").reshape(n, AROUND) for c in ("right", "left"))
    block = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    of = np.searchsorted(block, np.arange(n), side="right") - 1
    last = np.append(block[1:], n) - 1
    most, pairs = np.zeros(n, np.int32), []
    for other in (block[of] - 1, last[of] + 1):
        pair = np.full(n, -1, np.int32)
        beyond = (other < 0) | (other >= n)  # in another partition
        most[beyond] = AROUND  # unknown: left to the look-up by equality
        at = np.flatnonzero(~beyond)
        at = at[(key[at] == key[other[at]]) & (doc[at] != doc[other[at]])]
        r, l = _same_words(right[at], right[other[at]]), _same_words(left[at], left[other[at]])
        pair[at] = np.where(r + l + SURE >= MIN_WORDS, l * (AROUND + 1) + r, -1)
        most[at] = np.maximum(most[at], (r, l)[side])
        pairs.append(pair)
    there = (left, right)[side]
    rows = np.flatnonzero(most + (there != 0).sum(axis=1) + SURE >= MIN_WORDS)
    rows = rows[(rows >= begin) & (rows < end)]
    taken = table.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*(taken.column(c).combine_chunks() for c in ("key", "ctx", "doc_id", "place", "first")),
                                       *(pa.array(c[rows], pa.int32()) for c in (most, *pairs))],
                                      ["key", "ctx", "doc_id", "place", "first", "most", "before", "behind"])


def _compare(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range of the suffix array, in chunks that end where another document or key begins."""
        held, size, begin = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            key, doc = (table.column(c).to_numpy() for c in ("key", "doc_id"))
            cut = int(np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[-1:].sum()) + 1
            if cut > begin + 1:
                yield _matches(table, side, begin, cut)
                table, begin = table.slice(cut - 1), 1  # the last row is the neighbour of what follows
            held, size = table.combine_chunks().to_batches(), table.num_rows
        if size > begin:
            yield _matches(pa.Table.from_batches(held), side, begin, size)
    return run


def _neighbours(around: DataFrame, side: int) -> DataFrame:
    """``_matches`` in one sort order; ``around`` is a written table."""
    order = ["key", *(("right", "left"), ("left", "right"))[side], "doc_id", "place"]
    ranges = (around.repartitionByRange(partitions(around.sparkSession), *order).sortWithinPartitions(*order)
              .select("key", "right", "left", "ctx", "doc_id", "place", "first"))
    return written(ranges.mapInArrow(_compare(side), MATCHES), "matches")


def _left_open(matches: list[DataFrame]) -> DataFrame:
    """``key``, ``ctx``, ``doc_id``, ``place``, ``first``, ``lefts``: how many words left of a suffix's key the windows of ``MIN_WORDS`` words begin that may be shared and that no match covers."""
    right, left = (m.select("key", "ctx", "doc_id", "place", "first", F.col("most").alias(own), F.lit(None).cast("int").alias(other), F.array("before", "behind").alias("pairs"))
                   for m, own, other in zip(matches, ("r", "l"), ("l", "r"), strict=True))
    both = right.unionByName(left).groupBy("key", "ctx", "doc_id", "place").agg(
        F.min("first").alias("first"), F.max("r").alias("r"), F.max("l").alias("l"), F.flatten(F.collect_set("pairs")).alias("pairs"))

    def covered(at):
        return F.exists("pairs", lambda p: (p >= 0) & (at <= F.floor(p / (AROUND + 1))) & (F.lit(AROUND) - at <= p % (AROUND + 1)))
    lefts = F.filter(F.sequence(F.lit(AROUND) - F.col("r"), F.col("l")), lambda at: ~covered(at))
    return both.where(F.col("r") + F.col("l") >= AROUND).select("key", "ctx", "doc_id", "place", "first", lefts.alias("lefts")).where(F.size("lefts") > 0)


def _equal_windows(around: DataFrame, own: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``first`` of windows left open (``own``) that two documents hold, found by equality.

    All contexts of a key are looked through, but only suffixes with windows of their own left open get rows.
    """
    own = written(own, "open")
    open_ = written(own.select("key", F.explode("lefts").alias("at")).groupBy("key").agg(F.collect_set("at").alias("lefts")), "open-keys")
    # Equal contexts are one row with the smallest and the largest id, in an exchange of their own: what many
    # documents hold is folded before it meets its key, and a key with many contexts can be split.
    contexts = written(around.groupBy("key", "ctx", "right", "left").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "folded")
    words = [F.expr("substring(left, 1, 4 * at)"), F.expr(f"substring(right, 1, 4 * ({AROUND} - at))")]
    inside = F.expr(f"(at = 0 OR substring(left, 4 * at - 3, 4) <> X'00000000') AND (at = {AROUND} OR substring(right, 4 * ({AROUND} - at) - 3, 4) <> X'00000000')")
    windows = written(contexts.join(open_.hint("merge"), "key").select("key", "ctx", "right", "left", "lo", "hi", F.explode("lefts").alias("at")).where(inside)
                      .select("key", "ctx", "at", F.xxhash64(*words).alias("hash"), "lo", "hi"), "windows")
    shared = written(windows.groupBy("key", "at", "hash").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key", "at", "hash"), "windows")
    met = windows.join(shared.hint("merge"), ["key", "at", "hash"]).select("key", "ctx", "at")
    # Windows that follow each other are one stretch: a suffix has a row, not one for each of its windows.
    found = written(met.groupBy("key", "ctx").agg(F.collect_set("at").alias("ats")), "equal")
    held = own.join(found.hint("merge"), ["key", "ctx"]).withColumn("ats", F.array_intersect("ats", "lefts"))
    ends = [F.array_sort(F.filter("ats", lambda at: ~F.array_contains("ats", at + step))) for step in (-1, 1)]
    return (held.select("doc_id", "place", "first", F.inline(F.arrays_zip(ends[0].alias("least"), ends[1].alias("most"))))
            .select("doc_id", (F.col("place") - F.col("most")).alias("start"), (F.col("place") - F.col("least") + MIN_WORDS).alias("end"), "first"))


def _spans(matches: DataFrame) -> DataFrame:
    pair = matches.select("doc_id", "place", "first", F.explode(F.array("before", "behind")).alias("p")).where("p >= 0")
    return pair.select("doc_id", (F.col("place") - F.floor(F.col("p") / (AROUND + 1)).cast("int")).alias("start"),
                       (F.col("place") + SURE + F.col("p") % (AROUND + 1)).alias("end"), "first")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start_word``, ``end_word``, ``first_doc_id``, ``copy`` of passages that two documents share.

    ``first_doc_id`` is the smallest id that has a part of the passage; ``copy``
    tells whether that is another document. Spans with and without ``copy`` are
    united apart.
    """
    kept = written(suffixes(docs), "suffixes")
    # Written, so that the join shuffles both sides itself and can split a key that very many documents hold.
    shared = written(kept.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"), "shared")
    places = kept.join(shared.hint("merge"), "key")
    around = written(_contexts(docs, places).withColumn("ctx", F.xxhash64("right", "left")), "contexts")
    matches = [_neighbours(around, side) for side in (0, 1)]
    spans = (_spans(matches[0]).union(_spans(matches[1])).union(_equal_windows(around, _left_open(matches)))
             .select("doc_id", "start", "end", "first", (F.col("first") < F.col("doc_id")).alias("copy")).distinct())
    before = Window.partitionBy("doc_id", "copy").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("doc_id", "copy").orderBy("start", "end")
    return (spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
            .withColumn("island", F.sum("new").over(running))
            .groupBy("doc_id", "copy", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first").alias("first_doc_id"))
            .select("doc_id", "start_word", "end_word", "first_doc_id", "copy"))


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of ``copy`` spans cut out of ``text``; other columns as they are."""
    own = "_" * (max(map(len, docs.columns)) + 1)  # a name that no column has
    listed = spans.where("copy").groupBy(F.col("doc_id").alias(own + "id")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(own + "spans"))
    joined = docs.join(listed, docs["doc_id"] == listed[own + "id"], "left").drop(own + "id")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], names)
    return joined.mapInArrow(run, docs.schema)


def cut(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of ``spans`` and the white space behind them."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for span in spans:
        start, end = starts[span["start_word"]], starts[span["end_word"]]
        out.append(raw[at:max(at, start)])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
