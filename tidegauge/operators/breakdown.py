"""Top-N breakdowns with totals, "other" row, summary share and special rows.

Shape of every result: one row per displayed value plus, marked by ``kind``, a
``total`` row over all groups and optionally an ``other`` row. ``kind`` is what
tells them apart; the dim of those rows is NULL and so may a real dim be.

Plan: one shuffle of partially aggregated (dim, counters) rows. The top rows
and the totals both read that shuffle (the second read is a reused exchange),
so the facts are scanned once and the totals never depend on the limit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.aggregates import COUNTERS, resum, row_amount, row_counters, share
from tidegauge.operators.predicates import (
    facet_filters, known_columns, minutes_between, page_filter, without_own,
)
from tidegauge.spec import Facet, LogTable, Query, TimeRange

VALUE, TOTAL, OTHER, SELECTED = "value", "total", "other", "selected"
EMPTY_LABEL = "(empty)"

# Labels that stand for no single value and do not scale the bars.
SYNTHETIC_DIMS = ("(same)", "(empty)", "(other)")


def by_count() -> list[Column]:
    """Most frequent first; equal counts by value, so that the cut is stable."""
    return [F.col("cnt").desc(), F.col("dim").asc()]


def _measures(df: DataFrame) -> list[str]:
    return [c for c in (*COUNTERS, "summary_cnt") if c in df.columns]


def _kinded(df: DataFrame, kind: str, dim: Column | None = None) -> DataFrame:
    names = _measures(df)
    dim = F.lit(None).cast("string") if dim is None else dim
    return df.select(F.lit(kind).alias("kind"), dim.alias("dim"), *names)


def top_and_totals(groups: DataFrame, n: int, order: Sequence[Column] | None = None,
                   with_other: bool = False, hide_null: bool = False) -> DataFrame:
    """Cut aggregated ``(dim, counters)`` rows to the top ``n``; add the totals row.

    The other row is totals minus the rows shown and only exists if it counts
    anything.
    """
    names = _measures(groups)
    shown = groups.filter(F.col("dim").isNotNull()) if hide_null else groups
    top = shown.orderBy(*(order or by_count())).limit(n)
    total = groups.agg(*resum(names))
    parts = _kinded(top, VALUE, F.col("dim")).unionByName(_kinded(total, TOTAL))
    if with_other:
        shown = top.select(*[(-F.col(c)).alias(c) for c in names])
        rest = total.unionByName(shown).agg(*resum(names)).filter("cnt > 0")
        parts = parts.unionByName(_kinded(rest, OTHER))
    return parts


def _facet_rows(df: DataFrame, table: LogTable, facet: Facet, query: Query,
                dim: str | None = None) -> DataFrame:
    """Filtered per-row contributions for one facet: (dim[, raw], counters[, summary])."""
    kept = page_filter(df, table, query, without_own(query.filters, facet.dim))
    if facet.extra:
        kept = kept & F.expr(facet.extra)
    columns = row_counters(table, query.by_bytes and facet.by_bytes)
    if facet.summary:
        columns["summary_cnt"] = F.when(F.expr(facet.summary), row_amount(table)).otherwise(
            F.lit(0).cast("bigint"))
    value = F.expr(dim or facet.dim)
    value = F.explode(value) if facet.is_array else value
    return df.filter(kept).select(value.alias("dim"), *[c.alias(n) for n, c in columns.items()])


def facet_groups(df: DataFrame, table: LogTable, facet: Facet, query: Query) -> DataFrame:
    """All values of one facet with their counters, before any cut."""
    rows = _facet_rows(df, table, facet, query)
    return rows.groupBy("dim").agg(*resum(_measures(rows)))


def breakdown(df: DataFrame, table: LogTable, facet: Facet, query: Query,
              with_other: bool = False) -> DataFrame:
    """The flagship query: top-N values of a facet, totals, optional other row."""
    if facet.buckets:
        return bucketed_breakdown(df, table, facet, query)
    return top_and_totals(facet_groups(df, table, facet, query), query.top, with_other=with_other)


def bucketed_breakdown(df: DataFrame, table: LogTable, facet: Facet, query: Query) -> DataFrame:
    """Breakdown by label of a numeric expression, ordered by the smallest value.

    There are no more labels than rows asked for, so nothing is cut and the
    totals are one more group of the few label rows. Rows whose number is NULL
    have no label: they count in the totals only.
    """
    rows = _facet_rows(df, table, facet, query, dim=facet.raw).withColumnRenamed("dim", "raw")
    names = _measures(rows)
    groups = rows.groupBy(F.expr(facet.buckets(query.top, "raw")).alias("dim")).agg(
        *resum(names), F.min("raw").alias("lowest"))
    order = [F.col("lowest").asc(), F.col("dim").asc()]
    if len(facet.labels(query.top)) > query.top:
        return top_and_totals(groups, query.top, order, hide_null=True)
    empty = groups.schema["lowest"].dataType
    fan = F.array(F.struct(F.lit(VALUE).alias("kind"), F.col("dim"), F.col("lowest")),
                  F.struct(F.lit(TOTAL).alias("kind"), F.lit(None).cast("string").alias("dim"),
                           F.lit(None).cast(empty).alias("lowest")))
    both = groups.select(F.inline(fan), *names).filter((F.col("kind") == TOTAL) | F.col("dim").isNotNull())
    # An empty selection still has a totals row.
    none = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(TOTAL).alias("kind"), F.lit(None).cast("string").alias("dim"),
        F.lit(None).cast(empty).alias("lowest"), *[F.lit(0).cast("bigint").alias(n) for n in names])
    summed = both.unionByName(none).groupBy("kind", "dim", "lowest").agg(*resum(names))
    # All rows fit the limit; with it the order needs no range-partitioned sort.
    return summed.orderBy(F.col("kind").desc(), *order).limit(query.top + 1).drop("lowest")


# --- facets of very many values ---------------------------------------------

#: Hash buckets that bound the values' counts, and how many of the heaviest are counted exactly at first.
SPARSE_BUCKETS, HEAVY_BUCKETS = 1 << 16, 64
_PLACE = "_place"


def _placed(df: DataFrame, table: LogTable, facet: Facet, query: Query, buckets: int) -> DataFrame:
    rows = _facet_rows(df, table, facet, query)
    return rows.withColumn(_PLACE, F.pmod(F.xxhash64("dim"), F.lit(buckets)).cast("int"))


def _in_buckets(placed: DataFrame, chosen: set[int]) -> DataFrame:
    """Rows of the chosen buckets, whose number is bounded."""
    wanted = placed.sparkSession.createDataFrame([(b,) for b in sorted(chosen)], f"{_PLACE} int")
    return placed.join(F.broadcast(wanted), _PLACE, "left_semi")


def _exact_top(rows: DataFrame, n: int) -> list:
    """The leading values with all their counters, at most ``n`` rows."""
    return rows.groupBy("dim").agg(*resum(_measures(rows))).orderBy(*by_count()).limit(n).collect()


def sparse_breakdown(df: DataFrame, table: LogTable, facet: Facet, query: Query, with_other: bool = False,
                     buckets: int = SPARSE_BUCKETS) -> DataFrame:
    """``breakdown`` of a facet with very many values, without shuffling all of them.

    1. Counters per hash bucket of the value: the shuffle holds ``buckets`` rows per task
       at most, the totals are their sum, and no value counts more than its bucket.
    2. The values of the heaviest buckets are counted exactly. The last of the
       leading ones bounds from below what a value needs to be among them.
    3. Buckets that reach the bound and were not counted yet are counted with the others.

    The result is exact whatever the counts look like. With the usual few leading
    values, step 3 has nothing to do: two scans of the value's and the counters'
    columns instead of a shuffle as large as the facet. With even counts most
    buckets reach the bound and all values are shuffled as ``breakdown`` does,
    after scans that bought nothing: use it for facets known to be ``high_cardinality``.
    Counts must not be negative. Runs at once, as each step decides the next; what
    reaches the driver is bounded by ``buckets`` and the rows shown.
    """
    if facet.buckets:
        raise ValueError(f"facet {facet.name!r} has few values")
    placed = _placed(df, table, facet, query, buckets)
    names = _measures(placed)
    sums_ = {r[_PLACE]: r for r in placed.groupBy(_PLACE).agg(*resum(names)).collect()}
    by_weight = sorted(sums_, key=lambda b: (-sums_[b]["cnt"], b))
    counted = set(by_weight[:max(HEAVY_BUCKETS, 4 * query.top)])
    top = _exact_top(_in_buckets(placed, counted), query.top)
    bound = top[-1]["cnt"] if len(top) == query.top else None
    needed = {b for b in by_weight if bound is None or sums_[b]["cnt"] >= bound}
    if not needed <= counted:
        top = _exact_top(_in_buckets(placed, needed) if len(needed) < len(sums_) else placed, query.top)
    total = {n: sum(r[n] for r in sums_.values()) for n in names}
    rows = [(VALUE, r["dim"], *(r[n] for n in names)) for r in top] + [(TOTAL, None, *(total[n] for n in names))]
    rest = {n: total[n] - sum(r[n] for r in top) for n in names}
    if with_other and rest["cnt"] > 0:
        rows.append((OTHER, None, *(rest[n] for n in names)))
    kind = placed.schema["dim"].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"kind string, dim {kind}, " + ", ".join(f"{n} bigint" for n in names))


def fill_labels(result: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per expected label, in label order (``idx``), zeros where absent."""
    spark = result.sparkSession
    expected = spark.createDataFrame(list(enumerate(labels)), "idx int, dim string")
    names = _measures(result)
    found = result.filter(F.col("kind") == VALUE).drop("kind")
    return (expected.join(found, "dim", "left")
            .select("idx", "dim", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names])
            .orderBy("idx").limit(len(labels)))


def add_selected(result: DataFrame, groups: DataFrame, values: Iterable[str]) -> DataFrame:
    """Append selected values that did not make the top rows, as kind ``selected``.

    ``groups`` are all values of the facet without the other facets' filters.
    Displayed values are compared with displayed values, so facets whose filter
    works on another column (dictionary names, grouped errors) find theirs too.
    """
    wanted = [v for v in dict.fromkeys(values) if v != ""]
    if not wanted:
        return result
    shown = result.filter(F.col("kind") == VALUE).select("dim")
    missing = groups.filter(F.col("dim").isin(wanted)).join(shown, "dim", "left_anti")
    return result.unionByName(_kinded(missing, SELECTED, F.col("dim")), allowMissingColumns=True)


def own_values(facet: Facet, query: Query) -> list[str]:
    """The facet's values that the query selects or excludes."""
    return [str(f.value) for f in query.filters if f.col == facet.dim]


def selected_groups(df: DataFrame, table: LogTable, facet: Facet, query: Query,
                    names: DataFrame | None = None) -> DataFrame:
    """Counters of the facet's selected values without any facet's filter.

    Only rows of these values are shuffled. Values of dictionary facets read
    "<number> <name>", and their number is what rows hold.
    """
    values, rows = own_values(facet, query), _facet_rows(df, table, facet, replace(query, filters=()))
    looked_up = facet.dictionary and names is not None
    wanted = [v.split(" ", 1)[0] for v in values] if looked_up else values
    groups = (rows.withColumn("dim", F.col("dim").cast("string")).filter(F.col("dim").isin(wanted))
              .groupBy("dim").agg(*resum(_measures(rows))))
    return _named(groups, names) if looked_up else groups


def missing_selected(df: DataFrame, table: LogTable, facet: Facet, query: Query, with_other: bool = False,
                     names: DataFrame | None = None) -> DataFrame:
    """Breakdown plus the selected values outside the top rows."""
    if facet.dictionary and names is not None:
        result = dictionary_breakdown(df, names, table, facet, query, with_other=with_other)
    else:
        result = breakdown(df, table, facet, query, with_other=with_other)
    return add_selected(result, selected_groups(df, table, facet, query, names), own_values(facet, query))


def summary_share(result: DataFrame) -> DataFrame:
    """Share of the table's rows that meet the facet's summary condition."""
    return result.filter(F.col("kind") == TOTAL).select(
        "cnt", "summary_cnt", share(F.col("summary_cnt"), F.col("cnt")).alias("summary_ratio"))


def bar_percentages(result: DataFrame) -> DataFrame:
    """Percent of each class within a row, and the row's length relative to the
    longest row that stands for a single value."""
    real = ((F.col("kind") == VALUE) & (F.coalesce("dim", F.lit("")) != "")
            & ~F.coalesce(F.col("dim").isin(*SYNTHETIC_DIMS), F.lit(False)))
    # The result holds the top rows only, so one window over all of it is small.
    everything = Window.partitionBy(F.lit(0))
    longest = F.coalesce(F.max(F.when(real, F.col("cnt"))).over(everything), F.lit(1))
    pct = [(share(F.col(c), F.col("cnt")) * 100).alias(f"pct_{c[4:]}") for c in COUNTERS[1:]]
    bar = share(F.col("cnt"), longest) * 100
    return result.select("kind", "dim", "cnt", *pct, bar.alias("pct_bar"))


# --- per-minute roll-up -----------------------------------------------------

def rollup_breakdown(rollup: DataFrame, facet: Facet, query: Query, day: str | None = None,
                     with_other: bool = False) -> DataFrame:
    """The same breakdown from per-minute partial counters, re-summed on read."""
    kept = (F.col("facet") == facet.rollup) & minutes_between(rollup, query.range, day=day)
    if facet.extra:
        kept = kept & (F.col("dim") != "")
    rows = rollup.filter(kept)
    names = list(COUNTERS)
    if facet.dim_summary:
        rows = rows.withColumn("summary_cnt", F.when(F.expr(facet.dim_summary), F.col("cnt")).otherwise(0))
        names.append("summary_cnt")
    groups = rows.groupBy("dim").agg(*resum(names))
    return top_and_totals(groups, query.top, with_other=with_other)


def rollup_covers(table: LogTable, facet: Facet, query: Query) -> bool:
    """Can the roll-up answer this facet? Only unrestricted, unbucketed queries."""
    if not table.has_rollup or not facet.rollup or facet.raw:
        return False
    if query.host or query.filters or query.where:
        return False
    if query.owner_repo or query.search:
        return False
    if not facet.rollup_exact or (facet.high_cardinality and not table.rollup_high_cardinality):
        return False
    return not (query.by_bytes and facet.by_bytes)


def pick_source(df: DataFrame, rollup: DataFrame | None, table: LogTable, facet: Facet, query: Query,
                source: str = "auto", with_other: bool = False, rollup_day: str | None = None) -> DataFrame:
    """Breakdown from the roll-up where it has the answer, else from the rows."""
    covered = rollup is not None and rollup_covers(table, facet, query)
    if source == "rollup" and not covered:
        raise ValueError(f"the roll-up does not cover facet {facet.name!r} under this query")
    if source != "raw" and covered:
        return rollup_breakdown(rollup, facet, query, rollup_day, with_other)
    return breakdown(df, table, facet, query, with_other=with_other)


# --- many facets ------------------------------------------------------------

# Facets that share one scan. Each row fans out to one row per facet; beyond a
# handful the generated code of the fan-out outgrows what the JVM compiles and
# becomes several times slower than reading the shared columns again.
FACETS_PER_SCAN = 6
ALL_COUNTERS = (*COUNTERS, "summary_cnt")


def _shared_scan(base: DataFrame, table: LogTable, facets: Sequence[Facet], query: Query,
                 by_bytes: bool) -> DataFrame:
    """(facet, dim, counters, summary) groups of a few single-valued facets."""
    entries = []
    known = known_columns(table) or None
    # A bucket's label asks for its number many times: it is computed before.
    numbers = {f.name: f"_number_{i}" for i, f in enumerate(facets) if f.buckets}
    base = base.withColumns({numbers[f.name]: F.expr(f.raw) for f in facets if f.buckets})
    for facet in facets:
        counted = facet_filters(without_own(query.filters, facet.dim), known)
        if facet.extra:
            counted = counted & F.expr(facet.extra)
        dim = facet.buckets(query.top, numbers[facet.name]) if facet.buckets else facet.dim
        entries.append(F.when(counted, F.struct(
            F.lit(facet.name).alias("facet"), F.expr(dim).cast("string").alias("dim"),
            F.expr(facet.summary or "false").alias("summary"))))
    counters = row_counters(table, by_bytes)
    rows = base.select(F.explode(F.array(*entries)).alias("e"), row_amount(table).alias("amount"),
                       *[c.alias(n) for n, c in counters.items()])
    rows = rows.filter(F.col("e").isNotNull()).withColumn(
        "summary_cnt", F.when(F.col("e.summary"), F.col("amount")).otherwise(F.lit(0).cast("bigint")))
    return (rows.groupBy(F.col("e.facet").alias("facet"), F.col("e.dim").alias("dim"))
            .agg(*resum(ALL_COUNTERS)))


def _rollup_groups(rollup: DataFrame, facets: Sequence[Facet], query: Query, day: str | None) -> DataFrame:
    """The same groups of covered facets from one filtered scan of the roll-up."""
    kept, summary = F.lit(False), F.lit(False)
    for facet in facets:
        own = F.col("facet") == facet.rollup
        kept = kept | (own & (F.col("dim") != "") if facet.extra else own)
        if facet.dim_summary:
            summary = summary | (own & F.expr(facet.dim_summary))
    page_name = F.create_map(*[F.lit(x) for f in facets for x in (f.rollup, f.name)])
    rows = rollup.filter(F.col("facet").isin([f.rollup for f in facets]) & minutes_between(rollup, query.range, day=day) & kept)
    rows = rows.withColumn("summary_cnt", F.when(summary, F.col("cnt")).otherwise(F.lit(0).cast("bigint")))
    return rows.groupBy(page_name[F.col("facet")].alias("facet"), "dim").agg(*resum(ALL_COUNTERS))


def all_facets(df: DataFrame, table: LogTable, facets: Iterable[Facet], query: Query,
               with_other: bool = False, rollup: DataFrame | None = None, rollup_day: str | None = None) -> DataFrame:
    """Breakdowns of many facets, several per scan of the rows; what the roll-up
    covers comes from one scan of it.

    Columns: facet, kind, dim, counters and ``summary_cnt``, which is NULL for
    facets without a summary. Rows fan out after column pruning and are
    partially aggregated before the shuffle. The cut per facet is a row number
    limit, which Spark also applies before shuffling, so a facet that holds most
    of the groups does not gather in one task.
    """
    facets = list(facets)
    covered = [f for f in facets if rollup is not None and rollup_covers(table, f, query)]
    parts = [_rollup_groups(rollup, covered, query, rollup_day)] if covered else []
    rest = [f for f in facets if f not in covered]
    base = df.filter(page_filter(df, table, query, filters=()))
    for by_bytes in (False, True):
        alike = [f for f in rest if not f.is_array and (query.by_bytes and f.by_bytes) is by_bytes]
        parts += [_shared_scan(base, table, alike[i:i + FACETS_PER_SCAN], query, by_bytes)
                  for i in range(0, len(alike), FACETS_PER_SCAN)]
    for facet in rest:
        if facet.is_array:
            groups = facet_groups(df, table, replace(facet, summary=facet.summary or "false"), query)
            parts.append(groups.select(F.lit(facet.name).alias("facet"), "dim", *ALL_COUNTERS))
    groups = reduce(DataFrame.unionByName, parts)
    # Facets without any value still get their (zero) totals row.
    names = df.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.array(*[F.lit(f.name) for f in facets])).alias("facet"))
    bucketed = [f for f in facets if f.buckets]
    unlabelled = F.col("facet").isin([f.name for f in bucketed]) & F.col("dim").isNull()
    # Buckets come in the order of their labels, all else by count.
    places = [F.lit(x) for f in bucketed for i, label in enumerate(f.labels(query.top)) for x in (f"{f.name} {label}", i)]
    place = F.coalesce(F.create_map(*places)[F.concat_ws(" ", "facet", "dim")], F.lit(0)) if places else None
    result = top_and_totals_by(groups, ["facet"], query.top, with_other, names, unlabelled, place)
    summed = F.col("facet").isin([f.name for f in facets if f.summary])
    return result.withColumn("summary_cnt", F.when(summed, F.col("summary_cnt")))


def top_and_totals_by(groups: DataFrame, keys: list[str], n: int, with_other: bool = False,
                      known: DataFrame | None = None, hidden: Column | None = None, first: Column | None = None) -> DataFrame:
    """``top_and_totals`` for every key at once, and for all ``known`` keys.

    Rows rank by ``first``, if given, and then by count; ``hidden`` rows count in
    the totals only.
    """
    measures = _measures(groups)
    # Hidden rows rank last and go after ranking: a filter before it would move below
    # the aggregate, and top rows and totals would no longer read the same exchange.
    order = [c for c in (hidden, first) if c is not None]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *by_count()))
    top = groups.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
    top = top if hidden is None else top.filter(~hidden)
    counted = groups.select(*keys, *measures)
    if known is not None:
        zeros = [F.lit(0).cast("bigint").alias(c) for c in measures]
        counted = counted.unionByName(known.select(*keys, *zeros))
    total = counted.groupBy(*keys).agg(*resum(measures))
    null_dim = F.lit(None).cast("string")

    def labelled(df: DataFrame, kind: str, dim: Column) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), dim.alias("dim"), *measures)

    parts = labelled(top, VALUE, F.col("dim")).unionByName(labelled(total, TOTAL, null_dim))
    if with_other:
        less = top.select(*keys, *[(-F.col(c)).alias(c) for c in measures])
        rest = total.unionByName(less).groupBy(*keys).agg(*resum(measures)).filter("cnt > 0")
        parts = parts.unionByName(labelled(rest, OTHER, null_dim))
    return parts


def page_breakdowns(df: DataFrame, table: LogTable, facets: Iterable[Facet], query: Query,
                    names: DataFrame | None = None, with_other: bool = False,
                    rollup: DataFrame | None = None, rollup_day: str | None = None) -> DataFrame:
    """All facets of a page in one result: (facet, kind, dim, counters, summary_cnt).

    Facets the roll-up covers under this query are read from it, all others from
    the rows, ``FACETS_PER_SCAN`` to a scan and array facets one by one. ``names``
    (asn, name) completes the shown rows of dictionary facets, after the cut.
    Selected values outside the top rows follow as kind ``selected``. Buckets
    have no other row: their labels are all shown.
    """
    facets = list(facets)
    columns = ["facet", "kind", "dim", *ALL_COUNTERS]
    result = all_facets(df, table, facets, query, with_other, rollup, rollup_day)
    bucketed = [f.name for f in facets if f.buckets and len(f.labels(query.top)) <= query.top]
    result = result.filter(~(F.col("facet").isin(bucketed) & (F.col("kind") == OTHER))).select(*columns)
    looked_up = [f.name for f in facets if f.dictionary]
    if names is not None and looked_up:
        use = F.col("facet").isin(*looked_up) & (F.col("kind") == VALUE)
        result = result.filter(~use).unionByName(_named(result.filter(use), names).select(*columns))
    picked = []
    for facet in facets:
        if own_values(facet, query) and not facet.buckets:
            groups = selected_groups(df, table, facet, query, names)
            summary = F.col("summary_cnt") if facet.summary else F.lit(None).cast("bigint")
            picked.append(groups.select(F.lit(facet.name).alias("facet"), F.lit(SELECTED).alias("kind"), "dim", *COUNTERS, summary.alias("summary_cnt")))
    if picked:
        shown = result.filter(F.col("kind") == VALUE).select("facet", "dim")
        result = result.unionByName(reduce(DataFrame.unionByName, picked).join(shown, ["facet", "dim"], "left_anti").select(*columns))
    return result


def preview(df: DataFrame, table: LogTable, facets: Iterable[Facet], query: Query, part: TimeRange,
            names: DataFrame | None = None, with_other: bool = False,
            rollup: DataFrame | None = None, rollup_day: str | None = None) -> DataFrame:
    """Every facet over a part of the chart's range, from the same sources as the page."""
    return page_breakdowns(df, table, facets, replace(query, range=part), names, with_other, rollup, rollup_day)


# --- dictionary facets ------------------------------------------------------

def _named(groups: DataFrame, names: DataFrame, key: str = "asn") -> DataFrame:
    """``dim`` numbers become ``"<number> <name>"``; a number has one name, and without one an empty one.

    No broadcast hint: the dictionary side is joined by measured size.
    """
    one = names.select(F.col(key).cast("string").alias("dim"), "name").groupBy("dim").agg(F.max("name").alias("name"))
    label = F.concat(F.col("dim"), F.lit(" "), F.coalesce("name", F.lit("")))
    return groups.join(one, "dim", "left").withColumn("dim", label).drop("name")


def dictionary_breakdown(df: DataFrame, names: DataFrame, table: LogTable, facet: Facet, query: Query,
                         key: str = "asn", with_other: bool = False) -> DataFrame:
    """Breakdown by ``"<key> <name>"``: aggregate by key first, look names up after."""
    groups = facet_groups(df, table, facet, query)
    return top_and_totals(_named(groups.withColumn("dim", F.col("dim").cast("string")), names, key), query.top, with_other=with_other)
