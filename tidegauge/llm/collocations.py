"""Phrase collocations by relational mining of sorted occurrence relations.

Texts are cut at punctuation and line ends into pieces and those into words. The
relation of occurrences of length k holds where each candidate phrase of k words
begins. It is persisted as blocks of bounded size, each sorted by position; two
pieces are a position apart, so neighbouring positions lie in one piece. A round

1. counts the candidates of length k, first within blocks, then over all,
2. keeps the frequent ones, and by a semi-join of each block's candidates with
   them the occurrences of frequent phrases alone,
3. merge-joins these occurrences with themselves at the adjacent position: what
   begins at p and at p + 1 overlaps to a phrase of k + 1 words, both of whose
   parts are frequent. Both inputs are sorted, so one pass over a block does it.

A block brings its distinct candidates to the count and to the semi-join, not its
occurrences. What is shuffled most are pairs to be counted: a task sums those of
its blocks, a bounded number at a time, and ships them as sorted lists of the
lower bits of pairs whose mixed numbers begin alike. The semi-join sends up to ``BROADCAST`` frequent phrases to the
blocks; beyond, it is an equi-join of written tables, where a phrase that every
text holds is one row per block, and adaptive execution can split it.

A phrase is known by the numbers of its two parts, and those by theirs: counts
rest on no hash. Scores are integers of up to 38 digits.

A phrase's best cut and its longer rivals are found by equi-joins among frequent
phrases. A phrase inside a longer one that is as frequent is inside one that is a
word longer and as frequent, as counts can only fall with length; so looking at
rivals one word longer is enough.

Defined cases: NULL and empty texts have no words; a NULL language is ``und``;
rows that repeat an id are counted each; words are compared as bytes after A-Z
are lower-cased; a document of any length is cut into blocks, each with the few
positions behind its end that phrases begun in it need; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, partitions, written

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANGUAGE = "und"
#: Positions of a block, words and ends of pieces; with those behind it numbers fit 16 bits.
BLOCK = (1 << 16) - 8
#: Blocks' worth of words that a task holds, of all languages together, before it gives them out unfilled.
LANGUAGES = 8
#: Bytes of the Arrow batches of texts and blocks.
BATCH = 8 << 20
#: Frequent phrases of one length that are sent to all tasks, some 10 MB.
BROADCAST = 1 << 18
#: Pairs that a task sums before they are shuffled, some 100 MB while they are sorted.
SUMMED = 1 << 21
#: Odd number that mixes pairs, and its inverse among 64 bits.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
#: Bits of the map of frequent phrases that lets a block's candidates pass, a fixed 2 MB.
MAP_BITS = 1 << 24
#: Characters that end a piece; a tab or a space parts words.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")

# ``at`` marks the positions of occurrences, a bit each; ``idx`` numbers their
# candidates within the block, 16 bits each; ``n`` counts the block's own.
WORDS = "block long, lang string, own int, at binary, idx binary, word array<binary>, n array<int>"
PAIRS = "block long, lang string, own int, at binary, idx binary, a array<long>, b array<long>, n array<int>"


def tokens(text: str | None) -> list[bytes]:
    """Words in order; each end of a piece is a line end."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return [t for t in raw.replace(b"\n", b" \n ").split(b" ") if t]


class _Lines:
    """Words of one language, numbered, with -1 at the ends of pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"\n": -1}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, found: list[bytes]) -> None:
        number = self.number
        for word in set(found).difference(number):
            number[word] = len(number) - 1
        self.parts += [np.fromiter(map(number.__getitem__, found), np.int32, len(found)), np.full(1, -1, np.int32)]
        self.size += len(found) + 1

    def block(self, name: int, lang: str, own: int | None = None) -> pa.RecordBatch:
        """All words as a block, of which the first ``own`` positions are its own."""
        ids, own = np.concatenate(self.parts), self.size if own is None else own
        words = np.asarray(sorted(self.number.keys() - {b"\n"}), dtype=object)
        order = np.empty(words.size, np.int32)
        order[np.fromiter(map(self.number.__getitem__, words), np.int64, words.size)] = np.arange(words.size, dtype=np.int32)
        pos = np.flatnonzero(ids >= 0)
        idx = order[ids[pos]]
        counts = np.bincount(idx[pos < own], minlength=words.size).astype(np.int32)
        return _row(WORDS, [name, lang, own, *_packed(pos, idx), pa.array(words, pa.binary()), counts])


class _Blocks:
    """Collects the words of texts by language and gives them out as blocks."""

    def __init__(self, first: int):
        self.next = first
        self.held: dict[str, _Lines] = {}

    def _named(self) -> int:
        self.next += 1
        return self.next

    def add(self, lang: str, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(found) >= BLOCK:  # a long text: each part takes along what phrases begun in it need
            for at in range(0, len(found), BLOCK):
                lines = _Lines()
                lines.add(found[at:at + BLOCK + LONGEST - 1])
                yield lines.block(self._named(), lang, min(BLOCK, len(found) - at))
            return
        if lang in self.held and self.held[lang].size + len(found) >= BLOCK:
            yield self.held.pop(lang).block(self._named(), lang)
        self.held.setdefault(lang, _Lines()).add(found)
        if sum(lines.size for lines in self.held.values()) > LANGUAGES * BLOCK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, lines in self.held.items():
            yield lines.block(self._named(), lang)
        self.held = {}


def _packed(pos: np.ndarray, idx: np.ndarray) -> tuple[bytes, bytes]:
    marks = np.zeros(int(pos.max(initial=-1)) + 1, bool)
    marks[pos] = True
    return np.packbits(marks).tobytes(), idx.astype("<u2").tobytes()


def _unpacked(at: bytes, idx: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8))), np.frombuffer(idx, "<u2").astype(np.int64)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "binary": pa.binary()}
    kinds.update({f"array<{name}>": pa.list_(kind) for name, kind in kinds.items()})
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def _row(schema: str, values: list) -> pa.RecordBatch:
    arrays = []
    for value, kind in zip(values, (fields := _arrow(schema)).types, strict=True):
        if pa.types.is_list(kind):
            flat = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        else:
            arrays.append(pa.array([value], kind))
    return pa.RecordBatch.from_arrays(arrays, fields.names)


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of single words: blocks of ``WORDS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            for part, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = blocks or _Blocks(part << 40)
                yield from blocks.add(lang, tokens(text))
        if blocks:
            yield from blocks.flush()
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, WORDS)


def _pairs(block: int, lang: str, own: int, at: bytes, idx: bytes, ids: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block's occurrences that stayed, merge-joined with themselves at the adjacent position.

    ``ids``: numbers of the frequent candidates; ``place``: where a candidate's is, -1 for one that is not frequent.
    """
    pos, idx = _unpacked(at, idx)
    now = place[idx]
    pos, now = pos[now >= 0], now[now >= 0]
    first = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    pairs, inverse = np.unique(now[first] << 16 | now[first + 1], return_inverse=True)
    begin = pos[first]
    counts = np.bincount(inverse[begin < own], minlength=pairs.size).astype(np.int32)
    if pairs.size:
        yield _row(PAIRS, [block, lang, own, *_packed(begin, inverse), ids[pairs >> 16], ids[pairs & 0xFFFF], counts])


def _lists(column: pa.ListArray) -> Iterator[pa.Array]:
    ends = column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield column.values.slice(a, b - a)


def _extend(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """One block and its frequent candidates (place and number), as many as it has words at most."""
    stayed, ids = (found.column(c).to_numpy() for c in ("at", "id"))
    out = []
    for row in blocks.to_pylist():
        place = np.full(max(int(np.frombuffer(row["idx"], "<u2").max(initial=0)), int(stayed.max(initial=0))) + 1, -1, np.int64)
        place[stayed] = np.arange(stayed.size)
        out += _pairs(row["block"], row["lang"], row["own"], row["marks"], row["idx"], ids, place)
    return pa.Table.from_batches(out, _arrow(PAIRS))


class _Known:
    """Numbers of all frequent phrases, for tasks that look a block's candidates up where they are."""

    def __init__(self, keys: list[pa.Array], ids: pa.Array):
        self.by_word: dict | None = None
        order = np.arange(len(ids))
        if len(keys) == 2 and not pa.types.is_integer(keys[0].type):
            self.by_word = dict(zip(zip(*(k.to_pylist() for k in keys), strict=True), ids.to_pylist(), strict=True))
        else:
            packed = keys[0].to_numpy() << 32 | keys[1].to_numpy()  # numbers are gapless and few here
            order = np.argsort(packed)
            self.packed = packed[order]
        self.ids = ids.to_numpy()[order]

    def look_up(self, lang: str, keys: list[pa.Array]) -> np.ndarray:
        """Numbers of a block's candidates, -1 for those that are not frequent."""
        if self.by_word is not None:
            return np.fromiter((self.by_word.get((lang, w), -1) for w in keys[0].to_pylist()), np.int64, len(keys[0]))
        packed = keys[0].to_numpy() << 32 | keys[1].to_numpy()
        at = np.minimum(np.searchsorted(self.packed, packed), max(self.packed.size - 1, 0))
        return np.where(self.packed[at] == packed, self.ids[at], -1) if self.packed.size else np.full(packed.size, -1, np.int64)


class _Mixed:
    """Pairs of numbers below ``numbers`` as one number each, mixed so that its leading bits deal pairs evenly."""

    def __init__(self, numbers: int, tasks: int):
        self.half = np.uint64(max((numbers - 1).bit_length(), 1))
        whole = 2 * int(self.half)
        self.mask = np.uint64((1 << whole) - 1)
        # Some 32 buckets a task; what they leave of a number fits 31 and 16 bits.
        self.rest = max(whole - max(min(16, (32 * tasks).bit_length()), whole - 47), 0)

    def mixed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.uint64) << self.half | b.astype(np.uint64)
        return (pair ^ pair >> self.half) * np.uint64(ODD) & self.mask

    def pairs(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = mixed.astype(np.uint64) * np.uint64(INVERSE) & self.mask
        pair ^= pair >> self.half
        return (pair >> self.half).astype(np.int64), (pair & (self.mask >> self.half)).astype(np.int64)


#: Pairs of one bucket: the bits of each behind the bucket's, and seven bits of its count from ``shift`` on.
DEALT = "bucket int, shift int, high array<int>, low array<smallint>, n array<tinyint>"


def _lists_of(mix: _Mixed, mixed: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted pairs and their counts as rows of ``DEALT``; counts are split into digits of seven bits."""
    for shift in range(0, int(counts.max(initial=0)).bit_length(), 7):
        digit = counts >> shift & 127
        there = digit > 0
        numbers = mixed[there].astype(np.int64)
        bucket = numbers >> mix.rest
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = pa.array(np.append(starts, bucket.size).astype(np.int32))
        rest = numbers & ((1 << mix.rest) - 1)
        values = (rest >> 16).astype(np.int32), (rest & 0xFFFF).astype(np.uint16).view(np.int16), digit[there].astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(starts.size, shift, np.int32)),
                                          *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in values)], ["bucket", "shift", "high", "low", "n"])


def _dealt(relation: DataFrame, mix: _Mixed) -> DataFrame:
    """Candidate pairs with their counts, summed within tasks, as rows of ``DEALT``."""
    most = SUMMED

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        mixed, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(mixed)
        mixed = mixed[order]
        starts = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
        return mixed[starts], np.add.reduceat(counts[order], starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, n in zip(*map(_lists, batch.columns), strict=True):
                held.append((mix.mixed(a.to_numpy(), b.to_numpy()), n.to_numpy().astype(np.int64)))
                size += len(a)
                if size >= most:
                    held = [summed(held)]
                    size = held[0][0].size
                    if 2 * size >= most:  # few repeat
                        yield from _lists_of(mix, *held[0])
                        held, size = [], 0
        if size:
            yield from _lists_of(mix, *summed(held))
    return relation.select("a", "b", "n").mapInArrow(run, DEALT)


def _counted_pairs(relation: DataFrame, least: int, numbers: int) -> DataFrame:
    """``a``, ``b`` and count ``f`` of pairs of numbers below ``numbers`` that occur often enough."""
    tasks = partitions(relation.sparkSession)
    mix = _Mixed(numbers, tasks)
    each = (_dealt(relation, mix).repartition(tasks, "bucket").select("bucket", "shift", F.explode(F.arrays_zip("high", "low", "n")).alias("c"))
            .select("bucket", F.expr(f"shiftleft(CAST(bucket AS BIGINT), {mix.rest}) | shiftleft(CAST(c.high AS BIGINT), 16) | (CAST(c.low AS BIGINT) & 65535)").alias("pair"),
                    F.expr("shiftleft(CAST(c.n AS BIGINT), shift)").alias("n")))
    # A pair lies in one bucket, so the shuffle by buckets serves this aggregate.
    counted = each.groupBy("pair", "bucket").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("pair", "f")

    def parted():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, mix.pairs(batch.column(0).to_numpy())), batch.column(1)], ["a", "b", "f"])
        return one
    return map_batches(counted, "a long, b long, f long", parted)


def _frequent(relation: DataFrame, key: list[str], least: int, numbers: int = 0) -> tuple[DataFrame, int]:
    """``key``, count ``f`` and a gapless number ``id`` of candidates that occur often enough, and how many they are.

    Candidates are what is shuffled most. Pairs of numbers below ``numbers`` go as lists.
    """
    own = [c for c in key if c != "lang"]
    if key == ["a", "b"] and 0 < numbers < 1 << 31:
        counted = _counted_pairs(relation, least, numbers)
    else:
        each = relation.select("lang", F.explode(F.arrays_zip(*own, "n")).alias("c")).select("lang", *[F.col(f"c.{k}").alias(k) for k in own], F.col("c.n").alias("n"))
        counted = each.groupBy(*key).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    found = written(counted.withColumn("at", F.monotonically_increasing_id()), "frequent", "zstd", BATCH)
    # One count per partition: gapless numbers keep pairs of them short.
    sizes = sorted((r["p"], r["n"]) for r in found.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    starts = np.zeros(max((p for p, _ in sizes), default=0) + 2, np.int64)
    starts[[p + 1 for p, _ in sizes]] = [n for _, n in sizes]
    before = F.split(F.lit(",".join(map(str, np.cumsum(starts).tolist()))), ",")
    number = F.element_at(before, (F.shiftright("at", 33) + 1).cast("int")).cast("long") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return found.select(*key, "f", number.alias("id")), sum(n for _, n in sizes)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.int64) % MAP_BITS


def _slots(columns: list[pa.Array]) -> np.ndarray:
    """Place in the map of words (of any language) or pairs."""
    if len(columns) == 2:
        return _mixed(*(c.to_numpy(zero_copy_only=False) for c in columns))
    words = columns[0].to_pylist()
    return _mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.zeros(len(words), np.uint64))


def _passed(relation: DataFrame, frequent: DataFrame, key: list[str]) -> DataFrame:
    """``block``, ``lang``, ``at`` and ``key`` of candidates that may be frequent: all frequent ones and a few others.

    The map of frequent phrases has a fixed size; a fuller one lets more pass, and the join after it is exact.
    """
    own = [c for c in key if c != "lang"]

    def words():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            slots = np.unique(_slots(batch.columns))
            return pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.left_shift(np.int64(1), slots & 63))], ["word", "bits"])
        return one
    bits = np.zeros(MAP_BITS // 64, np.int64)
    for r in map_batches(frequent.select(*own), "word long, bits long", words).groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    shared = relation.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            flat = [batch.column(i + 2).values.slice(ends[0], ends[-1] - ends[0]) for i in range(len(own))]
            slots = _slots(flat)
            hit = np.flatnonzero(np.right_shift(found[slots >> 6], slots & 63) & 1)
            starts = ends - ends[0]
            row = np.searchsorted(starts, hit, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((hit - starts[row]).astype(np.int32)),
                                              *(c.take(pa.array(hit)) for c in flat)], ["block", "lang", "at", *own])
    kinds = {"word": "binary", "a": "long", "b": "long"}
    return relation.select("block", "lang", *own).mapInArrow(run, "block long, lang string, at int, " + ", ".join(f"{k} {kinds[k]}" for k in own))


def _extended(relation: DataFrame, frequent: DataFrame, size: int, key: list[str]) -> DataFrame:
    """The relation of phrases one word longer.

    Up to ``BROADCAST`` frequent phrases (of ``size``) travel to the blocks, which then stay where they are. More are
    semi-joined with the blocks' candidates, and what is found is brought to the blocks by a co-group, one block at a time.
    """
    own = [c for c in key if c != "lang"]
    if size <= BROADCAST:
        table = frequent.select(*key, "id").toArrow().combine_chunks()
        columns = [c.combine_chunks() for c in table.columns]
        shared = relation.sparkSession.sparkContext.broadcast((columns[:-1], columns[-1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Known(*shared.value)
            for batch in batches:
                head = zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)
                for one, *keys in zip(head, *(_lists(batch.column(5 + i)) for i in range(len(own))), strict=True):
                    ids = known.look_up(one[1], keys)
                    there = np.flatnonzero(ids >= 0)
                    place = np.full(ids.size, -1, np.int64)
                    place[there] = np.arange(there.size)
                    yield from _pairs(*one, ids[there], place)
        return written(relation.select("block", "lang", "own", "at", "idx", *own).mapInArrow(run, PAIRS), "occurrences", "zstd", BATCH)
    # Merged at every size: a few more frequent phrases must not turn a broadcast into a shuffle of all blocks.
    stay = _passed(relation, frequent, key).join(frequent.select(*key, "id").hint("merge"), key).select("block", "at", "id")
    blocks = relation.select("block", "lang", "own", F.col("at").alias("marks"), "idx")
    return written(blocks.groupBy("block").cogroup(stay.groupBy("block")).applyInArrow(_extend, PAIRS), "occurrences", "zstd", BATCH)


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (``lang``, ``size``, ``phrase``, ``f``) of 1 to ``longest`` (at most ``LONGEST``) words, and the words ``n`` of each language."""
    relation = written(occurrences(docs), "occurrences", "zstd", BATCH)
    totals = written(relation.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n")), "totals")
    key = ["lang", "word"]
    frequent, numbers = _frequent(relation, key, least)
    last = frequent.select("lang", "id", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f")
    found = last.select("lang", F.lit(1).alias("size"), "phrase", "f")
    for size in range(2, longest + 1):
        relation = _extended(relation, frequent, numbers, key)
        key = ["a", "b"]
        frequent, numbers = _frequent(relation, key, least, numbers)
        last = written(frequent.join(last.select("lang", F.col("id").alias("a"), F.col("phrase").alias("front")), "a")
                       .join(last.select(F.col("id").alias("b"), "last"), "b")
                       .select("lang", "id", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "f"), "phrases")
        found = found.union(last.select("lang", F.lit(size).alias("size"), "phrase", "f"))
    return written(found, "phrases"), totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of each language.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its worst cut.
    """
    found, totals = phrases(docs, longest, least)
    words = F.split("phrase", " ")
    # Phrases inside one that is a word longer and as frequent.
    longer = found.where("size > 2").withColumn("w", words)
    inside = (longer.select("lang", F.explode(F.array(F.expr("array_join(slice(w, 1, size - 1), ' ')"), F.expr("array_join(slice(w, 2, size - 1), ' ')"))).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("rival")))
    kept = (found.where("size > 1").join(inside, ["lang", "phrase"], "left").where("rival IS NULL OR rival < f")
            .select("lang", "phrase", F.col("f").alias("a"), "size"))
    cuts = (kept.withColumn("w", words).withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
            .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("front"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("back")))
    count = found.select("lang", "phrase", "f")
    big = "decimal(19,0)"
    scored = (cuts.join(count.withColumnsRenamed({"phrase": "front", "f": "l"}), ["lang", "front"])
              .join(count.withColumnsRenamed({"phrase": "back", "f": "r"}), ["lang", "back"]).join(totals, "lang")
              .withColumn("score", F.expr(f"(1000BD * cast(a as {big}) * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))")))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (worst.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
