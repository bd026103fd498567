"""Quotation linking: conversations in reply order, without what they quote.

A message is parsed into passages of equal quote level (the ``>`` signs before a
line). The normalised text of every passage is hashed. A quoted passage is joined
to the message of its conversation that said it first in its own words; the
quote of the lowest level that is found names the message replied to. Messages
that quote nothing, or nothing that is found, begin a thread of their own.

Passages end at blank lines and where the level changes. Normalised means: quote
signs taken off, letters lower-cased, white space of any length one space. A
passage may be said within a longer message: every own passage of a message, and
its whole own text, can be quoted.

Roots are found by pointer jumping: every round doubles the distance a message
looks back, so the rounds grow with the logarithm of the longest chain of replies.
Every step is an equi-join or an aggregate that combines before the shuffle; what
is said very often keeps one row per conversation, its first message.

Defined cases: NULL texts are empty and quote nothing; blank passages are neither
quoted nor found; messages that repeat a turn of a conversation are told apart
by role and text, and exact repeats are kept once; NULL conversations and turns
are values like others (NULL turns come first); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import id_ranges, partitions, range_of, written

#: Quote signs of a line, with the spaces between and behind them.
SIGNS = r"^(?:[ \t]*>)+[ \t]?"


def _lines(text: Column) -> Column:
    """Lines with their quote level and the text behind the signs."""
    return F.transform(F.split(text, "\r?\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, SIGNS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(line, SIGNS, "").alias("line")))


def _passages(text: Column) -> Column:
    """Passages (``level``, ``text``) in order: runs of lines of one level without a blank line between."""
    empty = F.array().cast("array<struct<level:int,text:string,open:boolean>>")

    def step(done: Column, one: Column) -> Column:
        last = F.element_at(done, -1)
        blank = F.trim(one["line"]) == ""
        joins = (F.size(done) > 0) & last["open"] & (last["level"] == one["level"])
        closed = F.when(F.size(done) > 0, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["level"].alias("level"), last["text"].alias("text"), F.lit(False).alias("open"))))).otherwise(done)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["level"].alias("level"), F.concat_ws("\n", last["text"], one["line"]).alias("text"), F.lit(True).alias("open"))))
        new = F.concat(done, F.array(F.struct(one["level"].alias("level"), one["line"].alias("text"), F.lit(True).alias("open"))))
        return F.when(blank, closed).when(joins, longer).otherwise(new)
    return F.aggregate(_lines(text), empty, step)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` (own words only), ``passages``, ``levels`` (deepest quote) and ``message``, an id made of all four."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("raw"))
    rows = rows.distinct().withColumn("passages", F.when(F.instr("raw", ">") > 0, _passages(F.col("raw"))).otherwise(F.transform(
        F.filter(F.split("raw", r"\r?\n(?:[ \t]*\r?\n)+"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.lit(0).alias("level"), p.alias("text"), F.lit(True).alias("open")))))
    own = F.filter("passages", lambda p: p["level"] == 0)
    return rows.select(
        F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")),
                           F.coalesce("role", F.lit("")), "raw"), 256).alias("message"),
        "conv_id", "turn", "role", F.array_join(F.transform(own, lambda p: p["text"]), "\n\n").alias("text"),
        F.transform("passages", lambda p: F.struct(p["level"].alias("level"), F.xxhash64(normalised(p["text"])).alias("hash"))).alias("passages"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("levels"))


def replies(messages: DataFrame) -> DataFrame:
    """``message``, ``parent`` for every message of written ``parsed`` messages that quotes an earlier one."""
    place = F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), F.col("message"))
    whole = F.when(F.trim("text") != "", F.array(F.xxhash64(normalised(F.col("text")))))
    own = F.array_distinct(F.concat(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["hash"]),
                                    F.coalesce(whole, F.array().cast("array<bigint>"))))
    said = (messages.select("conv_id", place.alias("place"), F.explode(own).alias("hash"))
            .groupBy("conv_id", "hash").agg(F.min("place").alias("origin")))
    quoted = (messages.select("conv_id", "message", place.alias("place"), F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
              .select("conv_id", "message", "place", F.col("p.level").alias("level"), F.col("p.hash").alias("hash")))
    met = quoted.join(said.withColumnsRenamed({"conv_id": "_conv", "hash": "_hash"}),
                      F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("hash") == F.col("_hash"))).where("origin < place")
    # Among quotes of the lowest level found, the latest message is the one replied to.
    best = F.max(F.struct((-F.col("level")).alias("near"), F.col("origin")))
    return met.groupBy("message").agg(best.alias("best")).select("message", F.col("best.origin.message").alias("parent"))


def threads(messages: DataFrame, parents: DataFrame) -> DataFrame:
    """``message``, ``parent``, ``root``, ``depth`` of every message, by pointer jumping.

    Only messages whose pointer moved take part in the next round; one whose
    pointer meets no other has reached its root. Joins are merged at every size,
    as both sides grow with the messages.
    """
    pointers = written(parents.select("message", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "threads")
    while not pointers.where("moved").isEmpty():
        ahead = pointers.select(F.col("message").alias("_m"), F.col("root").alias("_root"), F.col("depth").alias("_depth")).hint("merge")
        jumped = pointers.where("moved").join(ahead, F.col("root") == F.col("_m"), "left").select(
            "message", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.col("_m").isNotNull().alias("moved"))
        pointers = written(jumped.union(pointers.where("NOT moved")), "threads")
    found = pointers.drop("moved").hint("merge")
    return (messages.select("message").join(parents, "message", "left").join(found, "message", "left")
            .select("message", "parent", F.coalesce("root", "message").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth")))


def conversations(messages: DataFrame) -> DataFrame:
    """Messages in reply order without quotes.

    ``conv_id``, ``root_turn``, ``position`` (gapless within the thread, a reply
    behind what it replies to), ``turn``, ``parent_turn``, ``depth``, ``levels``,
    ``role``, ``text``.
    """
    found = written(parsed(messages), "messages")
    placed = threads(found, written(replies(found), "replies"))
    turns = found.select(F.col("message").alias("_m"), F.col("turn").alias("_turn"))
    named = (found.drop("passages").join(placed, "message")
             .join(turns.withColumnsRenamed({"_m": "_r", "_turn": "root_turn"}), F.col("root") == F.col("_r"))
             .join(turns.withColumnsRenamed({"_m": "_p", "_turn": "parent_turn"}), F.col("parent") == F.col("_p"), "left").drop("_r", "_p"))
    named = written(named, "named")
    # A thread is numbered in ranges of turns, so that a very long one is no single task's.
    named = named.withColumn("_range", range_of("turn", id_ranges(named, "turn", partitions(messages.sparkSession))))
    rank = Window.partitionBy("root", "depth", "_range").orderBy("turn", "message")
    before = Window.partitionBy("root").orderBy("depth", "_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (named.groupBy("root", "depth", "_range").agg(F.count("*").alias("_n"))
             .select("root", "depth", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (named.withColumn("_nth", F.row_number().over(rank) - 1).join(sizes, ["root", "depth", "_range"])
            .select("conv_id", "root_turn", (F.col("_start") + F.col("_nth")).alias("position"), "turn", "parent_turn", "depth", "levels", "role", "text"))


def as_mail(messages: DataFrame, levels: int = 2) -> DataFrame:
    """Messages as they look in a mail archive: each quotes the ``levels`` turns before it, one sign more each."""
    row = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def quote(of: Column, signs: int) -> Column:
        return F.when(of.isNotNull(), F.concat(F.lit("\n\n"), F.regexp_replace(of, "(?m)^", "> " * signs)))
    parts = [quote(F.lag(text, i).over(row), i) for i in range(1, levels + 1)]
    return messages.select("conv_id", "turn", "role", F.concat(text, *[F.coalesce(p, F.lit("")) for p in parts]).alias("text"))
