"""Anomaly detection and contrast over series of the access-log view."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from checks.sqltext import MONTH_WHERE, counters
from checks.traffic import DUCK_STATUS_RANGE
from tidegauge.operators import anomaly as an
from tidegauge.operators import timeseries as ts
from tidegauge.plans.dashboards import APP_LOGS, DELIVERY
from tidegauge.plans.page import Page
from tidegauge.spec import Query

# Six-hour buckets over the month, one series per organisation.
STEP = timedelta(hours=6)
QUERY = Query(replace(v.MONTH, step=STEP))
KEY = ["platform_org"]
MARGIN = 2

SERIES_SQL = f"""
  d AS (SELECT platform_org, time_bucket(to_seconds(21600), timestamp, TIMESTAMP '1970-01-01') AS t, {counters()}
        FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2),
  sp AS (SELECT platform_org, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 18:00:00', to_seconds(21600))) AS t
         FROM (SELECT DISTINCT platform_org FROM d)),
  s AS (SELECT platform_org, t, CAST(coalesce(cnt_ok, 0) AS BIGINT) AS cnt_ok, CAST(coalesce(cnt_4xx, 0) AS BIGINT) AS cnt_4xx,
               CAST(coalesce(cnt_5xx, 0) AS BIGINT) AS cnt_5xx FROM d FULL JOIN sp USING (platform_org, t))"""


def series(spark, sf):
    return ts.classes_over_time(v.access(spark, sf), DELIVERY, QUERY, keys=KEY)


def deviations_sql(measures: dict[str, str]) -> str:
    long = " UNION ALL ".join(f"SELECT platform_org, '{c}' AS category, t, CAST({m} AS DOUBLE) AS v FROM s" for c, m in measures.items())
    return SERIES_SQL + f""",
  l AS ({long}),
  i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY platform_org, category) AS n FROM l
        WINDOW w AS (PARTITION BY platform_org, category ORDER BY t)),
  x AS (SELECT *, i >= 2 AND i < n - {MARGIN} AS valid FROM i WHERE n >= 8),
  b AS (SELECT platform_org, category, median(v) FILTER (valid) AS baseline FROM x GROUP BY 1, 2),
  dv AS (SELECT x.*, baseline, CASE WHEN baseline > 0 THEN (v - baseline) / baseline ELSE 0 END AS deviation FROM x JOIN b USING (platform_org, category)),
  sg AS (SELECT platform_org, category, coalesce(stddev_pop(deviation) FILTER (valid), 0) AS sigma FROM dv GROUP BY 1, 2),
  dvs AS (SELECT dv.*, sigma FROM dv JOIN sg USING (platform_org, category))"""


CLASSES = {"green": "cnt_ok", "yellow": "cnt_4xx", "red": "cnt_5xx"}
SINGLE = {"error": "cnt_4xx * 2 + cnt_5xx * 5", "success": "cnt_ok"}


# Written down here as well, so that a changed weight in the library does not agree with itself.
_KINDS = tuple((c, "", kind, w) for c, kind, w in (
    ("red", "spike", 2), ("red", "dip", 1), ("yellow", "spike", 2), ("yellow", "dip", 1), ("green", "spike", 2), ("green", "dip", 2)))
_SINGLE_KINDS = (("error", "", "spike", 10), ("success", "", "dip", 10), ("success", "", "spike", 1))


def regions_sql(measures: dict[str, str], kinds) -> str:
    table = ", ".join(f"('{c}', '{kind}', {w}, {i})" for i, (c, _, kind, w) in enumerate(kinds))
    return deviations_sql(measures) + f""",
  o AS (SELECT *, CASE WHEN deviation > sigma THEN 'spike' WHEN deviation < -sigma THEN 'dip' END AS type FROM dvs WHERE valid),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY platform_org, category, type ORDER BY i) AS run FROM o WHERE type IS NOT NULL),
  kinds(category, type, weight, kind_idx) AS (VALUES {table}),
  r0 AS (SELECT platform_org, category, type, CAST(min(i) AS BIGINT) AS start, CAST(max(i) AS BIGINT) AS "end", count(*) AS duration,
                sum(abs(deviation)) AS total_deviation, max(abs(deviation)) AS peak_deviation, min(t) AS start_time, max(t) AS end_time
         FROM g GROUP BY 1, 2, 3, run),
  r AS (SELECT r0.*, total_deviation / duration AS avg_deviation, peak_deviation * sqrt(duration) * weight AS score, kind_idx
        FROM r0 JOIN kinds USING (category, type))"""


# The greedy choice as repeated "best region far enough from those taken".
def selection_sql(measures, kinds, most: int) -> str:
    steps = [regions_sql(measures, kinds), """
  c AS (SELECT *, row_number() OVER (PARTITION BY platform_org ORDER BY score DESC, kind_idx, start) AS id,
               CAST(ceil(("end" - start + 1) / 2.0) AS BIGINT) AS reach FROM r)"""]
    for n in range(1, most + 1):
        free = " AND ".join(
            f"""NOT EXISTS (SELECT 1 FROM k{m} k WHERE k.platform_org = c.platform_org
                AND NOT (c."end" < k.start - (c.reach + k.reach) OR c.start > k."end" + (c.reach + k.reach)))"""
            for m in range(1, n)) or "true"
        steps.append(f" k{n} AS (SELECT c.*, CAST({n} AS BIGINT) AS rank FROM c WHERE {free} "
                     f"QUALIFY row_number() OVER (PARTITION BY platform_org ORDER BY id) = 1)")
    union = " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(1, most + 1))
    return ",".join(steps) + f", picked AS ({union})"


PICKED = 'platform_org, rank, category, type, start, "end", start_time, end_time, duration, round(peak_deviation, 6) AS peak_deviation, round(score, 6) AS score'


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def sql(body: str) -> str:
    return v.with_views("access", "WITH " + body)


@check("an_baseline", sql(deviations_sql(CLASSES) + " SELECT * FROM b"))
def _(spark, sf):
    return an.deviations(series(spark, sf), KEY, MARGIN).select(*KEY, "category", "baseline").distinct()


@check("an_deviation", sql(deviations_sql(CLASSES) + " SELECT platform_org, category, i, t, round(deviation, 6) AS deviation FROM dvs"))
def _(spark, sf):
    out = an.deviations(series(spark, sf), KEY, MARGIN).select(*KEY, "category", F.col("i").cast("bigint").alias("i"), "t", "deviation")
    return rounded(out, "deviation")


@check("an_sigma", sql(deviations_sql(CLASSES) + " SELECT platform_org, category, round(sigma, 6) AS sigma FROM sg"))
def _(spark, sf):
    out = an.deviations(series(spark, sf), KEY, MARGIN).select(*KEY, "category", "sigma")
    return rounded(out, "sigma").distinct()


@check("an_regions", sql(regions_sql(CLASSES, _KINDS) + """ SELECT platform_org, category, type, start, "end", duration,
    round(total_deviation, 6) AS total_deviation, round(peak_deviation, 6) AS peak_deviation, round(avg_deviation, 6) AS avg_deviation FROM r"""))
def _(spark, sf):
    out = an.regions(an.deviations(series(spark, sf), KEY, MARGIN), KEY)
    out = out.select(*KEY, "category", "type", "start", "end", "duration", "total_deviation", "peak_deviation", "avg_deviation")
    return rounded(out, "total_deviation", "peak_deviation", "avg_deviation")


@check("an_score", sql(regions_sql(CLASSES, _KINDS) + " SELECT platform_org, category, type, start, round(score, 6) AS score FROM r"))
def _(spark, sf):
    out = an.regions(an.deviations(series(spark, sf), KEY, MARGIN), KEY)
    return rounded(out.select(*KEY, "category", "type", "start", "score"), "score")


@check("an_select", sql(selection_sql(CLASSES, _KINDS, 3) + f" SELECT {PICKED} FROM picked"))
def _(spark, sf):
    scored = an.regions(an.deviations(series(spark, sf), KEY, MARGIN), KEY)
    return rounded(an.select_regions(scored, KEY, most=3), "peak_deviation", "score")


@check("an_detect_steps", sql(selection_sql(CLASSES, _KINDS, 5) + f" SELECT {PICKED} FROM picked"))
def _(spark, sf):
    return rounded(an.detect(series(spark, sf), KEY, MARGIN), "peak_deviation", "score")


@check("an_detect_step", sql(selection_sql(SINGLE, _SINGLE_KINDS, 1) + f" SELECT {PICKED.replace('rank, ', '')} FROM picked"))
def _(spark, sf):
    return rounded(an.detect_single(series(spark, sf), KEY, MARGIN), "peak_deviation", "score")


FRESH = datetime(2024, 1, 30, 12, 2)


@check("an_end_margin", sql(SERIES_SQL + f""" SELECT platform_org, count(*) FILTER (t >= TIMESTAMP '{FRESH - timedelta(minutes=3)}') AS end_margin,
    epoch(max(t)) - epoch(min(t)) >= 300 AS long_enough FROM s GROUP BY 1"""))
def _(spark, sf):
    return an.end_margin(series(spark, sf), KEY, FRESH)


@check("an_detect_fresh", sql(selection_sql(CLASSES, _KINDS, 5).replace("i < n - 2", f"i < n - (SELECT count(*) FROM s z WHERE z.platform_org = i.platform_org AND z.t >= TIMESTAMP '{FRESH - timedelta(minutes=3)}')")
                              + f" SELECT {PICKED} FROM picked"))
def _(spark, sf):
    return rounded(an.detect_fresh(series(spark, sf), KEY, FRESH), "peak_deviation", "score")


@check("an_bounds", sql(selection_sql(CLASSES, _KINDS, 5) + ' SELECT platform_org, rank, start_time, end_time FROM picked'))
def _(spark, sf):
    return an.detect(series(spark, sf), KEY, MARGIN).select(*KEY, "rank", "start_time", "end_time")


@check("an_drill", sql(selection_sql(CLASSES, _KINDS, 5) + f""",
    f AS (SELECT platform_org, time_bucket(to_seconds(21600), timestamp, TIMESTAMP '1970-01-01') AS t, request_host AS dim,
                 {DUCK_STATUS_RANGE} AS status_class, weight, response_status FROM access WHERE {MONTH_WHERE})
    SELECT f.platform_org, rank, dim, {counters()} FROM f JOIN picked p ON f.platform_org = p.platform_org
      AND f.t BETWEEN p.start_time AND p.end_time
      AND f.status_class = CASE p.category WHEN 'red' THEN '5xx' WHEN 'yellow' THEN '4xx' ELSE '2xx' END
    GROUP BY 1, 2, 3"""))
def _(spark, sf):
    found = an.detect(series(spark, sf), KEY, MARGIN)
    return an.anomaly_rows(v.access(spark, sf), DELIVERY, DELIVERY.facets["hosts"], QUERY, found,
                           {"platform_org": "platform_org"})


# The same over one series without a key: the SQL keeps its key column, filled with a constant.
def _one_series(view: str, columns: str, body: str) -> str:
    one = f"one AS (SELECT 'all' AS platform_org, {columns} FROM {view}), "
    return v.with_views(view, "WITH " + one + body.replace("FROM access", "FROM one"))


_ACCESS_COLUMNS = "timestamp, weight, response_status, request_host"
_APP_COLUMNS = ("timestamp, 1 AS weight, function_name, "
                "CASE WHEN lower(level) = 'error' THEN 500 WHEN lower(level) IN ('warn', 'warning') THEN 400 ELSE 200 END AS response_status")


@check("an_detect_total", _one_series("access", _ACCESS_COLUMNS, selection_sql(CLASSES, _KINDS, 5).replace(
    "i < n - 2", f"i < n - (SELECT count(*) FROM s z WHERE z.t >= TIMESTAMP '{FRESH - timedelta(minutes=3)}')")
    + f" SELECT {PICKED.replace('platform_org, ', '')} FROM picked"))
def _(spark, sf):
    page = Page(DELIVERY, v.access(spark, sf))
    return rounded(page.anomalies(QUERY, FRESH), "peak_deviation", "score")


@check("an_drill_app_logs", _one_series("app_log", _APP_COLUMNS, selection_sql(CLASSES, _KINDS, 5) + f""",
    f AS (SELECT platform_org, time_bucket(to_seconds(21600), timestamp, TIMESTAMP '1970-01-01') AS t, regexp_replace(function_name, '/[^/]+$', '') AS dim,
                 response_status, weight FROM one WHERE {MONTH_WHERE})
    SELECT rank, dim, {counters()} FROM f JOIN picked p ON f.t BETWEEN p.start_time AND p.end_time
      AND f.response_status = CASE p.category WHEN 'red' THEN 500 WHEN 'yellow' THEN 400 ELSE 200 END
    GROUP BY 1, 2"""))
def _(spark, sf):
    lines = v.app_log_in(spark, sf)
    found = an.detect(ts.classes_over_time(lines, APP_LOGS, QUERY), [], MARGIN)
    return an.anomaly_rows(lines, APP_LOGS, APP_LOGS.facets["function-name"], QUERY, found, {})


SPANS = [(datetime(2024, 1, 5, 6), datetime(2024, 1, 6, 17, 59)), (datetime(2024, 1, 20), datetime(2024, 1, 20, 23, 30))]
HIT = " OR ".join(f"date_trunc('minute', timestamp) BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in SPANS)


@check("an_contrast_facet", sql(f"""
  m AS (SELECT date_trunc('minute', timestamp) AS minute, request_host AS dim, {HIT} AS hit, {counters()}, CAST(sum(CASE WHEN response_status >= 500 THEN weight ELSE 0 END) AS BIGINT) AS cat
        FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2, 3),
  c AS (SELECT dim, CAST(coalesce(sum(cat) FILTER (hit), 0) AS BIGINT) AS anomaly_cat_cnt, CAST(coalesce(sum(cat) FILTER (NOT hit), 0) AS BIGINT) AS baseline_cat_cnt,
               CAST(coalesce(sum(cnt) FILTER (hit), 0) AS BIGINT) AS anomaly_total_cnt, CAST(coalesce(sum(cnt) FILTER (NOT hit), 0) AS BIGINT) AS baseline_total_cnt FROM m GROUP BY 1)
  SELECT * FROM c WHERE anomaly_cat_cnt > 0 OR baseline_cat_cnt > 0 ORDER BY anomaly_cat_cnt DESC, dim LIMIT 50"""))
def _(spark, sf):
    return an.contrast_anomaly(v.access(spark, sf), DELIVERY, DELIVERY.facets["hosts"], Query(v.MONTH), SPANS, "red")


SELECTED = f"date_trunc('minute', timestamp) BETWEEN TIMESTAMP '{SPANS[0][0]}' AND TIMESTAMP '{SPANS[0][1]}'"


@check("an_contrast_selection", sql(f"""
  m AS (SELECT platform_path AS dim, {SELECTED} AS hit, {counters()} FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2)
  SELECT dim, CAST(coalesce(sum(cnt) FILTER (hit), 0) AS BIGINT) AS selection_cnt, CAST(coalesce(sum(cnt) FILTER (NOT hit), 0) AS BIGINT) AS baseline_cnt,
         CAST(coalesce(sum(cnt_4xx + cnt_5xx) FILTER (hit), 0) AS BIGINT) AS selection_err_cnt,
         CAST(coalesce(sum(cnt_4xx + cnt_5xx) FILTER (NOT hit), 0) AS BIGINT) AS baseline_err_cnt
  FROM m GROUP BY 1 ORDER BY selection_cnt DESC, dim LIMIT 50"""))
def _(spark, sf):
    return an.contrast_selection(v.access(spark, sf), DELIVERY, DELIVERY.facets["path"], Query(v.MONTH), SPANS[0])


_CONTRAST = {"hosts": ("request_host", "true"), "methods": ("request_method", "true"), "paths": ("request_url", "true"), "request-type": ("platform_request_type", "platform_request_type <> ''"),
             "status": ("CAST(response_status AS VARCHAR)", "true"), "asn": ("CAST(client_asn AS VARCHAR)", "client_asn <> 0")}
_FAN = "SELECT platform_org, time_bucket(to_seconds(21600), timestamp, TIMESTAMP '1970-01-01') AS t, '{}' AS facet, {} AS dim, weight, response_status FROM access WHERE {} AND {}"
_CONTRAST_ROWS = " UNION ALL ".join(_FAN.format(name, dim, MONTH_WHERE, extra) for name, (dim, extra) in _CONTRAST.items())


@check("an_contrast_all", sql(selection_sql(CLASSES, _KINDS, 5) + f""",
    fx AS (SELECT platform_org, t, facet, dim, {counters()} FROM ({_CONTRAST_ROWS}) GROUP BY 1, 2, 3, 4),
    cx AS (SELECT p.platform_org, p.rank, p.category, f.facet, f.dim, f.t BETWEEN p.start_time AND p.end_time AS hit, cnt,
                 CASE p.category WHEN 'red' THEN cnt_5xx WHEN 'yellow' THEN cnt_4xx ELSE cnt_ok END AS cat FROM fx AS f JOIN picked p ON p.platform_org = f.platform_org),
    gx AS (SELECT platform_org, rank, category, facet, dim, CAST(coalesce(sum(cat) FILTER (hit), 0) AS BIGINT) AS anomaly_cat_cnt, CAST(coalesce(sum(cat) FILTER (NOT hit), 0) AS BIGINT) AS baseline_cat_cnt,
                 CAST(coalesce(sum(cnt) FILTER (hit), 0) AS BIGINT) AS anomaly_total_cnt, CAST(coalesce(sum(cnt) FILTER (NOT hit), 0) AS BIGINT) AS baseline_total_cnt
          FROM cx GROUP BY 1, 2, 3, 4, 5)
    SELECT platform_org, rank, category, facet, row_number() OVER (PARTITION BY platform_org, rank, facet ORDER BY anomaly_cat_cnt DESC, dim) AS place, dim,
           anomaly_cat_cnt, baseline_cat_cnt, anomaly_total_cnt, baseline_total_cnt
    FROM gx WHERE anomaly_cat_cnt > 0 OR baseline_cat_cnt > 0
    QUALIFY row_number() OVER (PARTITION BY platform_org, rank, facet ORDER BY anomaly_cat_cnt DESC, dim) <= 50"""))
def _(spark, sf):
    """Every detected anomaly over six facets, from one scan."""
    found = an.detect(series(spark, sf), KEY, MARGIN)
    return an.contrast_anomalies(v.access(spark, sf), DELIVERY, [DELIVERY.facets[n] for n in _CONTRAST], QUERY, found, {"platform_org": "platform_org"})


_SELECTED_SPANS = (("a", "2024-01-03 07:00:00", "2024-01-04 01:30:00"), ("b", "2024-01-10 00:00:00", "2024-01-10 00:00:00"), ("c", "2023-01-01 00:00:00", "2023-01-01 06:00:00"))


@check("an_contrast_selections", sql(f"""
    px(selection, a, b) AS (VALUES {', '.join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in _SELECTED_SPANS)}),
    fx AS (SELECT t, facet, dim, {counters()} FROM ({_CONTRAST_ROWS}) GROUP BY 1, 2, 3),
    gx AS (SELECT selection, facet, dim, CAST(coalesce(sum(cnt) FILTER (hit), 0) AS BIGINT) AS selection_cnt, CAST(coalesce(sum(cnt) FILTER (NOT hit), 0) AS BIGINT) AS baseline_cnt,
                 CAST(coalesce(sum(cnt_4xx + cnt_5xx) FILTER (hit), 0) AS BIGINT) AS selection_err_cnt, CAST(coalesce(sum(cnt_4xx + cnt_5xx) FILTER (NOT hit), 0) AS BIGINT) AS baseline_err_cnt
          FROM (SELECT *, t BETWEEN time_bucket(to_seconds(21600), a, TIMESTAMP '1970-01-01') AND time_bucket(to_seconds(21600), b, TIMESTAMP '1970-01-01') AS hit FROM fx, px) GROUP BY 1, 2, 3)
    SELECT selection, facet, row_number() OVER w AS place, dim, selection_cnt, baseline_cnt, selection_err_cnt, baseline_err_cnt
    FROM gx WINDOW w AS (PARTITION BY selection, facet ORDER BY selection_cnt DESC, dim) QUALIFY row_number() OVER w <= 50"""))
def _(spark, sf):
    """Three selected spans, one of them without any row, over six facets."""
    spans = spark.createDataFrame(list(_SELECTED_SPANS), "selection string, a string, b string").selectExpr("selection", "cast(a AS timestamp_ntz) AS start_time", "cast(b AS timestamp_ntz) AS end_time")
    return an.contrast_selections(v.access(spark, sf), DELIVERY, [DELIVERY.facets[n] for n in _CONTRAST], QUERY, spans)


@check("agg_minute_lines", v.with_views("access", f"""
  SELECT date_trunc('minute', timestamp) AS minute, request_method AS dim, {counters()} FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2"""))
def _(spark, sf):
    return an.minute_counters(v.access(spark, sf), DELIVERY, DELIVERY.facets["methods"], Query(v.MONTH))


@check("two_level_minute", sql(f"""
  m AS (SELECT date_trunc('minute', timestamp) AS minute, request_method AS dim, {counters()} FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2)
  SELECT dim, CAST(coalesce(sum(cnt_5xx) FILTER (minute >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS late_5xx, CAST(sum(cnt) AS BIGINT) AS cnt FROM m GROUP BY 1"""))
def _(spark, sf):
    minutes = an.minute_counters(v.access(spark, sf), DELIVERY, DELIVERY.facets["methods"], Query(v.MONTH))
    late = F.when(F.col("minute") >= F.lit("2024-01-20").cast("timestamp_ntz"), F.col("cnt_5xx")).otherwise(0)
    return minutes.groupBy("dim").agg(F.sum(late).cast("bigint").alias("late_5xx"), F.sum("cnt").cast("bigint").alias("cnt"))


@check("rank_top_contributors", sql(f"""
  c AS (SELECT platform_org, request_url AS dim, CAST(sum(CASE WHEN response_status >= 500 THEN weight ELSE 0 END) AS BIGINT) AS errors
        FROM access GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY platform_org ORDER BY errors DESC, dim) AS rank FROM c)
  SELECT *, rank <= 3 AS highlight FROM r WHERE rank <= 30"""))
def _(spark, sf):
    errors = F.when(F.col("response_status") >= 500, F.col("weight")).otherwise(0)
    counts = v.access(spark, sf).groupBy("platform_org", F.col("request_url").alias("dim")).agg(
        F.sum(errors).cast("bigint").alias("errors"))
    return an.top_contributors(counts, ["platform_org"], "errors")
