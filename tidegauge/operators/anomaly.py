"""Anomalies in traffic series, and what distinguishes them.

Input is a series table: key columns, ``t`` and the three class counters, one
row per bucket. Everything is partitioned by series (and class), whose length
is bounded by the buckets of a range; facts never pass through these windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.aggregates import resum, row_counters, sums
from tidegauge.operators.predicates import facet_filters, known_columns, moment, page_filter, without_own
from tidegauge.operators.timeseries import bucket
from tidegauge.spec import MINUTE, STATUS_COUNTERS, Facet, LogTable, Query, floor_to

# Fixed values.
START_MARGIN = 2
SHORTEST_SERIES = 8
SHORTEST_SPAN = timedelta(minutes=5)
SETTLING_TIME = timedelta(minutes=3)
MOST_SELECTED = 5
CONTRAST_ROWS = 50
CONTRIBUTORS_KEPT = 30
CONTRIBUTORS_SHOWN = 3

# Class counter and weights of spikes and dips, in tie order.
KINDS = (
    ("red", "cnt_5xx", "spike", 2),
    ("red", "cnt_5xx", "dip", 1),
    ("yellow", "cnt_4xx", "spike", 2),
    ("yellow", "cnt_4xx", "dip", 1),
    ("green", "cnt_ok", "spike", 2),
    ("green", "cnt_ok", "dip", 2),
)
# Fixed values for the single-winner form: errors score 2 per 4xx and 5 per 5xx.
SINGLE_KINDS = (
    ("error", "errors", "spike", 10),
    ("success", "cnt_ok", "dip", 10),
    ("success", "cnt_ok", "spike", 1),
)
ERROR_SCORE = "cnt_4xx * 2 + cnt_5xx * 5"

# The status class an anomaly's drill-down filters on.
DRILL_STATUS = {"red": "5xx", "yellow": "4xx", "green": "2xx"}


def end_margin(series: DataFrame, keys: Sequence[str], as_of: datetime) -> DataFrame:
    """Per series: trailing buckets too fresh to judge, and whether the series
    spans long enough to be judged at all."""
    fresh = F.col("t") >= moment(series, "t", as_of - SETTLING_TIME)
    span = F.unix_seconds(F.max("t").cast("timestamp")) - F.unix_seconds(F.min("t").cast("timestamp"))
    return series.groupBy(*keys).agg(
        F.count_if(fresh).cast("bigint").alias("end_margin"),
        (span >= int(SHORTEST_SPAN.total_seconds())).alias("long_enough"))


def _numbered(series: DataFrame, keys: Sequence[str], margin: Column) -> DataFrame:
    """Bucket index, series length and the flag of buckets between the margins."""
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    numbered = series.withColumns({
        "i": F.row_number().over(whole.orderBy("t")) - 1,
        "n": F.count(F.lit(1)).over(whole),
        "end_margin": margin,
    })
    valid = (F.col("i") >= START_MARGIN) & (F.col("i") < F.col("n") - F.col("end_margin"))
    return numbered.withColumn("valid", valid).filter(F.col("n") >= SHORTEST_SERIES)


def deviations(series: DataFrame, keys: Sequence[str], margin: int | Column = 2,
               kinds: Sequence[tuple] = KINDS) -> DataFrame:
    """Long form (series, category, i, t, v): baseline median of the valid part,
    relative deviation from it, and the deviations' population sigma."""
    margin = F.lit(margin) if isinstance(margin, int) else margin
    measures = dict.fromkeys((category, column) for category, column, _, _ in kinds)
    entries = [F.struct(F.lit(category).alias("category"), F.col(column).cast("double").alias("v"))
               for category, column in measures]
    long = (_numbered(series, keys, margin)
            .withColumn("e", F.explode(F.array(*entries)))
            .select(*keys, "e.category", "i", "t", "n", "valid", "e.v"))
    group = Window.partitionBy(*keys, "category")
    baseline = F.coalesce(F.median(F.when(F.col("valid"), F.col("v"))).over(group), F.lit(0.0))
    with_base = long.withColumn("baseline", baseline)
    deviation = F.when(F.col("baseline") > 0, (F.col("v") - F.col("baseline")) / F.col("baseline")).otherwise(0.0)
    with_dev = with_base.withColumn("deviation", deviation)
    sigma = F.coalesce(F.stddev_pop(F.when(F.col("valid"), F.col("deviation"))).over(group), F.lit(0.0))
    return with_dev.withColumn("sigma", sigma)


def regions(devs: DataFrame, keys: Sequence[str], kinds: Sequence[tuple] = KINDS) -> DataFrame:
    """Maximal runs of valid buckets beyond one sigma, above (spike) or below (dip)."""
    direction = (F.when(F.col("deviation") > F.col("sigma"), "spike")
                 .when(F.col("deviation") < -F.col("sigma"), "dip"))
    out = devs.filter("valid").withColumn("type", direction).filter(F.col("type").isNotNull())
    # Consecutive indexes minus their rank are constant within a run.
    by_index = Window.partitionBy(*keys, "category", "type").orderBy("i")
    runs = out.withColumn("run", F.col("i") - F.row_number().over(by_index))
    size = F.abs("deviation")
    found = runs.groupBy(*keys, "category", "type", "run").agg(
        F.min("i").cast("bigint").alias("start"),
        F.max("i").cast("bigint").alias("end"),
        F.count(F.lit(1)).cast("bigint").alias("duration"),
        F.sum(size).alias("total_deviation"),
        F.max(size).alias("peak_deviation"),
        F.min("t").alias("start_time"),
        F.max("t").alias("end_time"),
    ).drop("run")
    found = found.withColumn("avg_deviation", F.col("total_deviation") / F.col("duration"))
    weight, order = F.lit(None), F.lit(None)
    for position, (category, _, kind, points) in enumerate(kinds):
        this = (F.col("category") == category) & (F.col("type") == kind)
        weight = F.when(this, F.lit(points)).otherwise(weight)
        order = F.when(this, F.lit(position)).otherwise(order)
    scored = found.withColumns({"kind_idx": order, "weight": weight}).filter(F.col("weight").isNotNull())
    score = F.col("peak_deviation") * F.sqrt(F.col("duration").cast("double")) * F.col("weight")
    return scored.withColumn("score", score).drop("weight")


def _reach(region: Column) -> Column:
    """Half a region's width, rounded up: how far it keeps others away."""
    return F.ceil((region["end"] - region["start"] + 1) / 2)


def select_regions(scored: DataFrame, keys: Sequence[str], most: int = MOST_SELECTED) -> DataFrame:
    """Best-first choice of at most ``most`` regions that keep their distance.

    A series has fewer regions than buckets, so gathering the regions of one
    series in an array is bounded; the fold over it stays in the JVM.
    """
    order = [(-F.col("score")).alias("o"), F.col("kind_idx"), F.col("start"), F.col("end"),
             *[F.col(c) for c in ("category", "type", "duration", "total_deviation", "peak_deviation",
                                  "avg_deviation", "score", "start_time", "end_time")]]
    listed = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("all"))
    element = listed.schema["all"].dataType.simpleString()

    def add(kept: Column, candidate: Column) -> Column:
        def collides(other: Column) -> Column:
            distance = _reach(other) + _reach(candidate)
            return ~((candidate["end"] < other["start"] - distance)
                     | (candidate["start"] > other["end"] + distance))
        full = F.size(kept) >= most
        return F.when(full | F.exists(kept, collides), kept).otherwise(F.concat(kept, F.array(candidate)))

    chosen = listed.select(*keys, F.posexplode(
        F.aggregate("all", F.array().cast(element), add)).alias("pos", "r"))
    fields = [F.col(f"r.{c}").alias(c) for c in (
        "category", "type", "start", "end", "start_time", "end_time", "duration",
        "peak_deviation", "score")]
    return chosen.select(*keys, (F.col("pos") + 1).cast("bigint").alias("rank"), *fields)


def detect(series: DataFrame, keys: Sequence[str], margin: int | Column = 2,
           most: int = MOST_SELECTED) -> DataFrame:
    """Up to ``most`` ranked anomalies per series over the three classes."""
    return select_regions(regions(deviations(series, keys, margin), keys), keys, most)


def detect_fresh(series: DataFrame, keys: Sequence[str], as_of: datetime,
                 most: int = MOST_SELECTED) -> DataFrame:
    """``detect`` with each series' own end margin; too short spans are skipped.

    The margin is a window over the series, whose buckets meet in one task for
    the detection anyway; without keys all buckets are one series.
    """
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    fresh = F.col("t") >= moment(series, "t", as_of - SETTLING_TIME)
    seconds = F.unix_seconds(F.col("t").cast("timestamp"))
    marked = (series.withColumn("span", F.max(seconds).over(whole) - F.min(seconds).over(whole))
              .withColumn("fresh", F.count_if(fresh).over(whole).cast("bigint"))
              .filter(F.col("span") >= int(SHORTEST_SPAN.total_seconds())).drop("span"))
    return detect(marked, keys, F.col("fresh"), most)


def detect_single(series: DataFrame, keys: Sequence[str], margin: int | Column = 2) -> DataFrame:
    """The one most significant anomaly per series: errors up, traffic down or up."""
    scored = regions(
        deviations(series.withColumn("errors", F.expr(ERROR_SCORE)), keys, margin, SINGLE_KINDS),
        keys, SINGLE_KINDS)
    best = select_regions(scored, keys, most=1)
    return best.drop("rank")


def drill_class(table: LogTable) -> Column:
    """The category (red, yellow, green) a row is shown under when drilling down.

    Tables with a response status go by its hundreds, green being answers of the
    200s; others by the table's own classes.
    """
    if dict(table.counters) == STATUS_COUNTERS:
        hundreds = F.expr("concat(response_status div 100, 'xx')")
        return F.element_at(F.create_map(*[F.lit(x) for category, status in DRILL_STATUS.items() for x in (status, category)]), hundreds)
    return (F.when(F.expr(table.counters["5xx"]), "red").when(F.expr(table.counters["4xx"]), "yellow")
            .when(F.expr(table.counters["ok"]), "green"))


def anomaly_rows(df: DataFrame, table: LogTable, facet: Facet, query: Query, anomalies: DataFrame,
                 series_keys: dict[str, str]) -> DataFrame:
    """What is behind each anomaly: counters per facet value in its buckets,
    restricted to its class.

    ``series_keys`` maps the key columns of ``anomalies`` to fact expressions.
    The facts are reduced to (series, bucket, class, dim) before they meet the
    anomalies, each spread over its buckets; no range join is needed.
    """
    step = query.range.step
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step.total_seconds()))
    windows = anomalies.select(
        *series_keys, "rank", "category",
        F.explode(F.sequence("start_time", "end_time", width)).alias("t"))
    kept = page_filter(df, table, query, without_own(query.filters, facet.dim))
    rows = df.filter(kept & F.expr(facet.extra or "true"))
    counters = row_counters(table)
    grouped = (rows.select(
        *[F.expr(e).alias(k) for k, e in series_keys.items()],
        bucket(table.time, step).alias("t"), drill_class(table).alias("category"),
        F.expr(facet.dim).alias("dim"), *[c.alias(n) for n, c in counters.items()])
        .filter(F.col("category").isNotNull())
        .groupBy(*series_keys, "t", "category", "dim").agg(*resum()))
    joined = grouped.join(windows, [*series_keys, "t", "category"])
    return joined.groupBy(*series_keys, "rank", "dim").agg(*resum())


# --- contrast ---------------------------------------------------------------

def _facet_values(df: DataFrame, table: LogTable, facet: Facet, query: Query,
                  **more: Column) -> DataFrame:
    kept = page_filter(df, table, query, without_own(query.filters, facet.dim))
    rows = df.filter(kept & F.expr(facet.extra or "true"))
    counters = row_counters(table)
    return rows.select(*[c.alias(n) for n, c in more.items()], F.expr(facet.dim).alias("dim"),
                       *[c.alias(n) for n, c in counters.items()])


def minute_counters(df: DataFrame, table: LogTable, facet: Facet, query: Query) -> DataFrame:
    """Counters per minute and facet value."""
    minute = bucket(table.time, timedelta(minutes=1))
    return _facet_values(df, table, facet, query, minute=minute).groupBy("minute", "dim").agg(*resum())


def in_spans(df: DataFrame, time: str, spans: Sequence[tuple[datetime, datetime]]) -> Column:
    """Is the row's minute in one of the spans, whose last minutes count whole?"""
    hit = F.lit(False)
    for start, end in spans:
        hit = hit | ((F.col(time) >= moment(df, time, floor_to(start, MINUTE)))
                     & (F.col(time) < moment(df, time, floor_to(end, MINUTE) + MINUTE)))
    return hit


def _within_and_without(names: dict[str, tuple[str, str]]) -> list[Column]:
    columns: dict[str, Column] = {}
    for measure, (within, without) in names.items():
        columns[within] = F.when(F.col("hit"), F.expr(measure)).otherwise(0)
        columns[without] = F.when(~F.col("hit"), F.expr(measure)).otherwise(0)
    return sums(columns)


def contrast_anomaly(df: DataFrame, table: LogTable, facet: Facet, query: Query,
                     spans: Sequence[tuple[datetime, datetime]], category: str,
                     rows: int = CONTRAST_ROWS) -> DataFrame:
    """Per value: the category's and all requests within and outside the anomaly.

    The spans decide row by row, so values aggregate once; shuffling them per
    minute first would give the same sums.
    """
    counter = {"red": "cnt_5xx", "yellow": "cnt_4xx", "green": "cnt_ok"}[category]
    values = _facet_values(df, table, facet, query, hit=in_spans(df, table.time, spans))
    result = values.groupBy("dim").agg(*_within_and_without({
        counter: ("anomaly_cat_cnt", "baseline_cat_cnt"),
        "cnt": ("anomaly_total_cnt", "baseline_total_cnt"),
    }))
    return (result.filter("anomaly_cat_cnt > 0 OR baseline_cat_cnt > 0")
            .orderBy(F.col("anomaly_cat_cnt").desc(), F.col("dim")).limit(rows))


def contrast_selection(df: DataFrame, table: LogTable, facet: Facet, query: Query,
                       span: tuple[datetime, datetime], rows: int = CONTRAST_ROWS) -> DataFrame:
    """Per value: requests and errors within and outside a selected span."""
    values = _facet_values(df, table, facet, query, hit=in_spans(df, table.time, [span]))
    result = values.groupBy("dim").agg(*_within_and_without({
        "cnt": ("selection_cnt", "baseline_cnt"),
        "cnt_4xx + cnt_5xx": ("selection_err_cnt", "baseline_err_cnt"),
    }))
    return (result.filter("selection_cnt > 0 OR baseline_cnt > 0")
            .orderBy(F.col("selection_cnt").desc(), F.col("dim")).limit(rows))


def top_contributors(contrasts: DataFrame, keys: Sequence[str], score: str,
                     kept: int = CONTRIBUTORS_KEPT, shown: int = CONTRIBUTORS_SHOWN) -> DataFrame:
    """Highest scoring values per group with rank and a highlight flag."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("dim"))
    ranked = contrasts.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank") <= kept).withColumn("highlight", F.col("rank") <= shown)


# --- contrast of many anomalies or selections over many facets ---------------

# What spans are compared by: the counter that ranks values, and the second one.
_MEASURES = {"red": ("cnt_5xx", "cnt"), "yellow": ("cnt_4xx", "cnt"), "green": ("cnt_ok", "cnt"), "selection": ("cnt", "cnt_4xx + cnt_5xx")}


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on columns of equal names, NULL being a value like others."""
    other = right.withColumnsRenamed({n: f"_{n}" for n in names})
    met = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return left.join(other, met, how).drop(*[f"_{n}" for n in names])


def facet_buckets(df: DataFrame, table: LogTable, facets: Sequence[Facet], query: Query, series_keys: Mapping[str, str]) -> DataFrame:
    """Counters per series, bucket of the range's step, facet and value, from one scan of the facts."""
    known = known_columns(table) or None
    entries = []
    for facet in facets:
        if facet.is_array or facet.buckets:
            raise ValueError(f"facet {facet.name!r} has no single plain value")
        counted = facet_filters(without_own(query.filters, facet.dim), known) & F.expr(facet.extra or "true")
        entries.append(F.when(counted, F.struct(F.lit(facet.name).alias("facet"), F.expr(facet.dim).cast("string").alias("dim"))))
    base = df.filter(page_filter(df, table, query, filters=()))
    # Plain names and no lambdas in the plan: both would make its second use look like another exchange.
    keys = {f"_key_{i}": (k, e) for i, (k, e) in enumerate(series_keys.items())}
    rows = base.select(*[F.expr(e).alias(n) for n, (_, e) in keys.items()], bucket(table.time, query.range.step).alias("t"),
                       F.explode(F.array(*entries)).alias("e"), *[c.alias(n) for n, c in row_counters(table).items()])
    groups = rows.filter(F.col("e").isNotNull()).groupBy(*keys, "t", F.col("e.facet").alias("facet"), F.col("e.dim").alias("dim")).agg(*resum())
    return groups.withColumnsRenamed({n: k for n, (k, _) in keys.items()})


def _contrast_spans(groups: DataFrame, spans: DataFrame, names: Sequence[str], keys: Sequence[str], ids: Sequence[str],
                    step: timedelta, rows: int) -> DataFrame:
    """``within`` and ``without`` of both counters of a span's measure, for the ``rows`` values that lead in it.

    ``spans``: ``keys``, ``ids``, ``measure``, ``start_time``, ``end_time`` (starts of its first and last bucket).
    Facts were reduced to buckets, and a span is the buckets it covers: membership is an equality. Values that
    do not occur in a span follow those that do, in their own order; the first few of each measure are enough to
    fill every list, so no span meets all values of a facet.
    """
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step.total_seconds()))
    named = [*keys, *ids, "measure"]
    covered = spans.select(*named, F.explode(F.sequence("start_time", "end_time", width)).alias("t"))

    def counted(place: int) -> Column:
        cases = F.lit(0).cast("bigint")
        for measure, counters in _MEASURES.items():
            cases = F.when(F.col("measure") == measure, F.expr(counters[place])).otherwise(cases)
        return cases
    met = _same(groups, covered, [*keys, "t"]).withColumns({"w1": counted(0), "w2": counted(1)})
    inside = met.groupBy(*named, "facet", "dim").agg(F.sum("w1").alias("w1"), F.sum("w2").alias("w2"), F.lit(False).alias("filler"))
    totals = groups.groupBy(*keys, "facet", "dim").agg(*resum())
    by_measure = totals.select(*keys, "facet", "dim", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.expr(first).alias("v")) for m, (first, _) in _MEASURES.items()]))).filter("v > 0")
    first = Window.partitionBy(*keys, "facet", "measure").orderBy("dim")
    fillers = by_measure.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= rows).select(*keys, "facet", "dim", "measure")
    none = F.lit(0).cast("bigint")
    listed = spans.select(*named, F.explode(F.array(*[F.lit(n) for n in names])).alias("facet"))
    filled = _same(fillers, listed, [*keys, "measure", "facet"]).select(*named, "facet", "dim", none.alias("w1"), none.alias("w2"), F.lit(True).alias("filler"))
    both = inside.unionByName(filled).groupBy(*named, "facet", "dim").agg(F.sum("w1").alias("w1"), F.sum("w2").alias("w2"), F.max("filler").alias("filler"))
    leading = Window.partitionBy(*named, "facet").orderBy(F.col("w1").desc(), F.col("dim"))
    top = both.filter("w1 > 0 OR filler").withColumn("place", F.row_number().over(leading)).filter(F.col("place") <= rows)
    found = _same(top.drop("filler"), totals, [*keys, "facet", "dim"])
    return found.select(*named, "facet", F.col("place").cast("bigint").alias("place"), "dim", "w1", (counted(0) - F.col("w1")).alias("o1"),
                        "w2", (counted(1) - F.col("w2")).alias("o2"))


def contrast_anomalies(df: DataFrame, table: LogTable, facets: Sequence[Facet], query: Query, anomalies: DataFrame,
                       series_keys: Mapping[str, str] | None = None, rows: int = CONTRAST_ROWS) -> DataFrame:
    """What each detected anomaly consists of, over many facets, in one plan and one scan of the facts.

    ``anomalies`` as ``detect`` gives them (series keys, ``rank``, ``category``, ``start_time``, ``end_time``)
    of series of ``query``. Per anomaly and facet the same rows and counters as ``contrast_anomaly`` gives for its
    span within the rows of its series, and their ``place``.
    """
    keys = list(series_keys or {})
    groups = facet_buckets(df, table, facets, query, series_keys or {})
    spans = anomalies.select(*keys, "rank", F.col("category").alias("measure"), "start_time", "end_time")
    found = _contrast_spans(groups, spans, [f.name for f in facets], keys, ["rank"], query.range.step, rows)
    return found.select(*keys, "rank", F.col("measure").alias("category"), "facet", "place", "dim", F.col("w1").alias("anomaly_cat_cnt"), F.col("o1").alias("baseline_cat_cnt"),
                        F.col("w2").alias("anomaly_total_cnt"), F.col("o2").alias("baseline_total_cnt"))


def contrast_selections(df: DataFrame, table: LogTable, facets: Sequence[Facet], query: Query, selections: DataFrame,
                        rows: int = CONTRAST_ROWS) -> DataFrame:
    """The same for spans that were selected (``selection``, ``start_time``, ``end_time``): requests and errors within and outside.

    Times are taken to the bucket of the range's step they lie in, the last one included.
    """
    groups = facet_buckets(df, table, facets, query, {})
    step = query.range.step
    spans = selections.select("selection", F.lit("selection").alias("measure"), "end_time", bucket("start_time", step).alias("start_time"))
    spans = spans.withColumn("end_time", bucket("end_time", step))
    found = _contrast_spans(groups, spans, [f.name for f in facets], [], ["selection"], step, rows)
    return found.select("selection", "facet", "place", "dim", F.col("w1").alias("selection_cnt"), F.col("o1").alias("baseline_cnt"),
                        F.col("w2").alias("selection_err_cnt"), F.col("o2").alias("baseline_err_cnt"))
