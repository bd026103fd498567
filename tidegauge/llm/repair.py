"""Conversation structure repair by an auction algorithm for shortest paths.

The edits of a conversation form a lattice: a node is a number of rows done and
the role reached (nothing yet, system, user, assistant); an arc keeps, reroles or
deletes the next row or inserts an empty message. Costs are integers. The auction
algorithm holds a price per node and a path that starts at the origin: the path
is extended along an arc whose cost equals the fall in price, or, where none
does, its end takes the lowest price that one allows and the path is contracted.
When it arrives, the origin's price is the cost of the cheapest repair, and the
arcs whose cost equals the fall in price are those of the cheapest paths. Of
these the one with the least string of initials is traced.

A long conversation is a chain of lattices of at most ``SEGMENT`` rows. From the
last to the first, the prices at a lattice's entry are the costs at the exit of
the one before it; from the first to the last, the least string through each is
traced. Every string ends with the edit of a lattice's last row, so none is the
beginning of another and the least of each makes the least of all. Solved
lattices are remembered by their rows' kinds, a bounded number of them.

Faults come from aggregates: equal rows of a turn are one row with a count, and
the first turn of a role and text tells repeats. Rows are then sorted in ranges
of (conversation, turn, role, text hash), so a conversation that holds a third of
all rows lies in many tasks, each of which writes one string per ``PART`` rows; only
these strings meet in one task. The hash of the repaired text is sequential by
nature: a task streams the rows of a conversation, and holds one at a time.

Rows of one turn are ordered by role and the SHA-256 of the text; texts are told
apart by that hash.

Defined cases: NULL roles and texts are one space, and so are NULL ids and turns
where damage is drawn; a NULL conversation is one like others, NULL turns come
first; equal rows are each damaged alike; conversations that lose all rows have
zeros, an empty audit and the hash of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACES, partitions, same, written

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: Rows of one lattice, and rows whose kinds one string holds before strings meet.
SEGMENT, PART = 16, 4096
FAR = 1 << 60
#: States of the role sequence ``(s?(ua)+)?``: nothing yet, after system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state when a role is written, and the states in which a sequence may end.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (0, FAR, FAR, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}

# Kinds of rows, one letter each: must go (x), or the initial s, u, a or o (any
# other), as a capital letter where the text breaks off.
GONE = "x"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with ``copies`` (0: dropped) after the damage drawn from conversation and turn."""
    blank = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    drawn = F.crc32(F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank)).cast("binary")) % 20
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), drawn.alias("d"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("copies"))


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it breaks off before the end of a sentence."""
    said = F.rtrim(text, F.lit(SPACES))
    return said == "", ~F.substring(said, -1, 1).isin(".", "!", "?")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows of a conversation with ``copies``, ``blank``, ``broken`` and ``first`` (the turn is the first with this role and text)."""
    blank, broken = _faults(F.col("text"))
    each = (rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), "copies", blank.alias("blank"), broken.alias("broken"))
            .groupBy("conv_id", "turn", "role", "sha", "blank", "broken").agg(F.sum("copies").alias("copies")))
    each = written(each, "judged")
    turn = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("turn"))
    again = (each.where("copies > 0 AND NOT blank").groupBy("conv_id", "role", "sha").agg(F.count("*").alias("turns"), F.min(turn).alias("begin"))
             .where("turns > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), F.col("begin.turn").alias("_t")))
    met = each.join(written(again, "again").hint("merge"), same(F.col("conv_id"), F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s")), "left")
    return met.select("conv_id", "turn", "role", "sha", "copies", "blank", "broken", (F.col("_s").isNull() | same(F.col("turn"), F.col("_t"))).alias("first"))


PARTS = "conv_id long, part long, kinds string, first string, last string, turns long, low long, high long, low_null boolean, blank long, duplicate long, truncated long, illegal long"
_PART_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]


def _legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au")


class _Part:
    """Kinds and counters of consecutive rows of one conversation."""

    def __init__(self, conv: int | None, number: int):
        self.conv, self.number, self.kinds = conv, number, []
        self.begin, self.end = None, None
        self.turns, self.low, self.high, self.null = 0, None, None, False
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, copies: int, blank: bool, broken: bool, first: bool) -> None:
        if turn is None:
            self.null = True
        elif turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.begin = initial if self.begin is None else self.begin
        ends = (self.end is not None and not _legal(self.end, initial)) + (copies - 1) * (not _legal(initial, initial))
        self.illegal, self.end = self.illegal + ends, initial
        kept = 0
        if blank:
            self.blank += copies
        else:
            kept = int(first)
            self.duplicate += copies - kept
            self.truncated += kept and broken
        if kept:
            kind = initial if initial in ("s", "u", "a") else "o"
            self.kinds.append(kind.upper() if broken else kind)
        self.kinds.append(GONE * (copies - kept))

    def row(self) -> tuple:
        return (self.conv, self.number, "".join(self.kinds), self.begin, self.end, self.turns, self.low, self.high, self.null,
                self.blank, self.duplicate, self.truncated, self.illegal)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per ``PART`` rows of a conversation."""
    part, size, done = None, 0, []

    def packed():
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PART_KINDS, strict=True)], [p.split()[0] for p in PARTS.split(", ")])
    for batch in batches:
        for number, conv, turn, initial, copies, blank, broken, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None or part.conv != conv or size >= PART:
                if part is not None:
                    done.append(part.row())
                at = part.number + 1 if part is not None else number << 40
                part, size = _Part(conv, at), 0
            if copies:
                part.add(turn, initial, copies, blank, broken, first)
                size += copies
        if len(done) > 1000:
            yield packed()
            done = []
    if part is not None:
        done.append(part.row())
        yield packed()


def _arcs(kinds: str, at: int, state: int, exits: tuple) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows done, state) from a node, ordered by initial; ('', cost, -1, 0) leaves the lattice."""
    if at == len(kinds):
        found = [("", exits[state], -1, 0)] if exits[state] < FAR else []
        return found if kinds else [*found, ("I", INSERT, 0, NEXT[state])]
    kind, out = kinds[at], [("D", DELETE, at + 1, state), ("I", INSERT, at, NEXT[state])]
    if kind != GONE:
        extra, role = BROKEN * kind.isupper(), kind.lower()
        to = {"s": SYSTEM if state == NOTHING else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(role)
        if to is not None:
            out.append(("K", KEEP + extra, at + 1, to))
        out.append(("R", REROLE + extra, at + 1, NEXT[state]))
    return out


class Lattice:
    """Prices of a lattice after an auction from each of its entries."""

    def __init__(self, kinds: str, exits: tuple):
        self.kinds, self.exits = kinds, exits
        self.arcs = {(i, s): _arcs(kinds, i, s, exits) for i in range(len(kinds) + 1) for s in range(4)}
        self.price = dict.fromkeys(self.arcs, 0)
        self.price[-1, 0] = 0
        for state in range(4):
            self._auction((0, state))
        self._alive = None

    def _auction(self, origin: tuple[int, int]) -> None:
        price, path = self.price, [origin]
        while path[-1][0] >= 0:
            end = path[-1]
            best, to = min(((cost + price[i, s], (i, s)) for _, cost, i, s in self.arcs[end]), default=(FAR, None))
            if price[end] < best:  # contract: no arc is as cheap as the price says
                price[end] = best
                if len(path) > 1:
                    path.pop()
                elif best >= FAR:
                    return
            else:
                path.append(to)

    def entries(self) -> tuple:
        return tuple(min(self.price[0, s], FAR) for s in range(4))

    def _tight(self, node: tuple[int, int]) -> list[tuple[str, tuple[int, int]]]:
        return [(letter, (i, s)) for letter, cost, i, s in self.arcs[node] if self.price[node] == cost + self.price[i, s]]

    def least(self, state: int) -> tuple[str, int]:
        """Initials of the least cheapest path from an entry, and the state at its exit."""
        if self._alive is None:  # nodes from which tight arcs lead out
            into: dict = {}
            for node in self.arcs:
                for _, to in self._tight(node):
                    into.setdefault(to, []).append(node)
            self._alive, open_ = {(-1, 0)}, [(-1, 0)]
            while open_:
                new = [n for n in into.get(open_.pop(), []) if n not in self._alive]
                self._alive.update(new)
                open_ += new
        node, out = (0, state), []
        while True:
            letter, to = min((letter, to) for letter, to in self._tight(node) if to in self._alive)
            if to[0] < 0:
                return "".join(out), node[1]
            out.append(letter)
            node = to


@lru_cache(maxsize=20_000)
def lattice(kinds: str, exits: tuple) -> Lattice:
    return Lattice(kinds, exits)


def repair(kinds: str) -> tuple[int, str]:
    """Cost and initials of the cheapest repair of rows of these kinds."""
    chain, base = [lattice("", ENDS)], 0
    for at in range((len(kinds) - 1) // SEGMENT * SEGMENT, -1, -SEGMENT) if kinds else ():
        exits = chain[-1].entries()
        low = min(exits)
        base += low
        chain.append(lattice(kinds[at:at + SEGMENT], tuple(min(e - low, FAR) for e in exits)))
    cost, state, out = base + chain[-1].entries()[NOTHING], NOTHING, []
    for one in reversed(chain):
        text, state = one.least(state)
        out.append(text)
    return cost, "".join(out)


DECIDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [p.split()[0] for p in DECIDED.split(", ")]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kinds, turns, low, high, end, sums = [], 0, None, None, None, [0, 0, 0, 0]
            for p in parts:
                kinds.append(p["kinds"])
                if p["low"] is not None:
                    turns += p["turns"] - (p["low"] == high)
                    low, high = p["low"] if low is None else low, p["high"]
                for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    sums[i] += p[name]
                if p["first"] is not None:
                    sums[3] += end is not None and not _legal(end, p["first"])
                    end = p["last"]
            gaps = 0 if low is None else high - low + 1 - turns
            cost, audit = repair("".join(kinds))
            out.append((conv, gaps, *sums, cost, audit))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(columns, _NAMES, strict=True)], _NAMES)


def decisions(rows: DataFrame) -> DataFrame:
    """``DECIDED`` of every conversation of written or cheap ``damaged`` rows."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sha"]
    sorted_ = judged(rows).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    parts = sorted_.select(F.spark_partition_id().cast("long").alias("number"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "broken", "first")
    together = (parts.mapInArrow(_parts, PARTS).groupBy("conv_id")
                .agg(F.sort_array(F.collect_list(F.struct("part", "kinds", "first", "last", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal"))).alias("parts")))
    return written(together.mapInArrow(_decide, DECIDED), "decided")


class _Text:
    """Repaired text of one conversation, hashed as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, NOTHING, hashlib.sha256(), True

    def _say(self, role: str, text: str) -> str:
        if not self.empty:
            self.hash.update(b"\n")
        self.empty = False
        self.hash.update(role.encode("utf-8", "surrogatepass") + b":")
        self.hash.update(text.encode("utf-8", "surrogatepass"))
        return role

    def insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._say(ROLES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self._say(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._say(ROLES[self.state], text)

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


REPAIRED = DECIDED + ", repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its decision, then its rows in order, to the decision with the hash of the repaired text."""
    text, head = None, None
    names = [*_NAMES, "repaired_sha256"]

    def packed(done):
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for c, n in zip(columns, names, strict=True)], names)
    for batch in batches:
        done = []
        for i, (decided, role, said, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("decided", "role", "text", "copies")), strict=True)):
            if decided is not None:
                if text is not None:
                    done.append((*head, text.digest()))
                head, text = [decided[n] for n in _NAMES], _Text(decided["audit"])
            else:
                for _ in range(copies):
                    text.row(role, said)
        if done:
            yield packed(done)
    if text is not None:
        yield packed([(*head, text.digest())])


def repaired(rows: DataFrame) -> DataFrame:
    """``REPAIRED`` of every conversation of ``damaged`` rows: faults, cost, audit and the hash of the repaired text."""
    found = decisions(rows)
    none = F.lit(None)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("sha"),
                         none.cast("string").alias("text"), none.cast("int").alias("copies"), F.struct(*_NAMES).alias("decided"))
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("sha"), "text", "copies",
                                            none.cast(heads.schema["decided"].dataType).alias("decided"))
    ordered = heads.union(texts).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "sha")
    return ordered.select("decided", "role", "text", "copies").mapInArrow(_hashed, REPAIRED)
