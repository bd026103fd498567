"""Breakdowns, predicates, time series and facets over the access-log views."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from checks.sqltext import (
    COUNTERS, LEVEL_COUNTERS, MONTH_WHERE, OUTCOME_COUNTERS, STATUS_COUNTERS, breakdown as sql_breakdown, counters, groups, resum,
    top_and_totals,
)
from tidegauge.functions import buckets as bk
from tidegauge.functions import classify
from tidegauge.functions.entities import with_entities
from tidegauge.operators import breakdown as bd
from tidegauge.operators import predicates as p
from tidegauge.operators import timeseries as ts
from tidegauge.operators.domains import Platform, customer_traffic
from tidegauge.operators.aggregates import dim_count, traffic_counters
from tidegauge.plans.dashboards import ADMIN, APP_LOGS, AUTHORING, AUTHORING_WORKERS, BACKEND, DELIVERY, MIXER
from tidegauge.plans.facets import APP_LOG_ROLLUP, CDN_ROLLUP
from tidegauge.plans.page import Page
from tidegauge.session import shared_folder
from tidegauge.sources.rollup import minute_rollup
from tidegauge.sources.writers import write_facts
from tidegauge.spec import FacetFilter, LogTable, Query, RANGE_PRESETS, TimeRange

MONTH = Query(v.MONTH, top=10)
UNWEIGHTED = replace(DELIVERY, weight=None)

# Dims whose SQL differs between the engines.
DUCK_STATUS_RANGE = "CAST(response_status // 100 AS VARCHAR) || 'xx'"
DUCK_ERROR = "regexp_replace(response_headers_x_error, '/[a-zA-Z0-9/_.-]+', '/...', 'g')"
DUCK_DIMS = {
    "status-range": DUCK_STATUS_RANGE,
    "errors": DUCK_ERROR,
    "ratelimit-rate": "CASE WHEN regexp_full_match(response_headers_x_ratelimit_rate, '[0-9]+') THEN CAST(response_headers_x_ratelimit_rate AS BIGINT) ELSE 0 END",
    "delivery-ratelimit-rate": "CASE WHEN regexp_full_match(response_headers_x_rate_limited_rate, '[0-9]+([.][0-9]*)?') THEN CAST(response_headers_x_rate_limited_rate AS DOUBLE) ELSE 0 END",
    "function-name": "regexp_replace(function_name, '/[^/]+$', '')",
    "function-version": "split_part(function_name, '/', -1)",
    "admin-method": "CASE WHEN json_valid(message) THEN coalesce(json_extract_string(message, '$.admin.method'), '') ELSE '' END",
    "admin-duration": "CASE WHEN json_valid(message) THEN coalesce(TRY_CAST(json_extract_string(message, '$.admin.duration') AS DOUBLE), 0) ELSE 0 END",
    "message": "left(message, 300)",
}


CONDITIONS = {APP_LOGS.name: LEVEL_COUNTERS, AUTHORING_WORKERS.name: OUTCOME_COUNTERS, MIXER.name: OUTCOME_COUNTERS}


# Summaries whose SQL differs between the engines.
DUCK_SUMMARIES: dict[str, str] = {}


def conditions_of(table: LogTable) -> dict[str, str]:
    return CONDITIONS.get(table.name, STATUS_COUNTERS)


def duck_dim(facet) -> str:
    return DUCK_DIMS.get(facet.name, facet.dim)


def duck_where(facet, where: str = MONTH_WHERE) -> str:
    return where + (f" AND ({facet.extra})" if facet.extra else "")


def views(names: str, sql: str) -> str:
    return v.with_views(names, sql)


# --- flagship and variants --------------------------------------------------

@check("breakdown_status_range", views("access", sql_breakdown(
    "access", DUCK_STATUS_RANGE, n=10, summary="response_status >= 500", other=True)))
def _(spark, sf):
    return bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["status-range"], MONTH, with_other=True)


@check("breakdown", views("access", sql_breakdown("access", "request_url")))
def _(spark, sf):
    return bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["paths"], replace(MONTH, top=5))


@check("totals", views("access", f"WITH g AS ({groups('access', 'request_url')}) SELECT {resum(COUNTERS)} FROM g"))
def _(spark, sf):
    out = bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["paths"], MONTH)
    return out.filter(F.col("kind") == bd.TOTAL).select(*COUNTERS)


@check("other_row", views("access", sql_breakdown("access", "cdn_datacenter", other=True)))
def _(spark, sf):
    return bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["datacenters"],
                        replace(MONTH, top=5), with_other=True)


@check("topn_sparse", views("access", sql_breakdown("access", "request_url", n=10, other=True)))
def _(spark, sf):
    """Leading values of a facet of many, without shuffling them all."""
    return bd.sparse_breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["paths"], MONTH, with_other=True)


@check("topn_sparse_ips", views("access", sql_breakdown("access", "cdn_originating_ip", n=10, other=True, summary="cdn_originating_ip LIKE '%:%'")))
def _(spark, sf):
    return Page(DELIVERY, v.access(spark, sf)).breakdown("ips", MONTH, source="sparse")


@check("topn", views("access", " UNION ALL ".join(
    f"SELECT * FROM (SELECT {n} AS n, dim, cnt FROM ({groups('access', 'platform_site', MONTH_WHERE + ' AND platform_site <> chr(0)')}) ORDER BY cnt DESC, dim LIMIT {n})"
    for n in (5, 10, 20, 50, 100))))
def _(spark, sf):
    df = v.access(spark, sf)
    parts = [bd.breakdown(df, DELIVERY, DELIVERY.facets["site"], replace(MONTH, top=n))
             .filter(F.col("kind") == bd.VALUE).select(F.lit(n).alias("n"), "dim", "cnt")
             for n in (5, 10, 20, 50, 100)]
    return reduce(DataFrame.unionByName, parts)


@check("summary_ratio", views("access", f"""
    SELECT cnt, summary_cnt, summary_cnt / cnt AS summary_ratio FROM (
      SELECT {counters(summary="request_method IN ('POST', 'PUT', 'PATCH', 'DELETE')")} FROM access WHERE {MONTH_WHERE})"""))
def _(spark, sf):
    return bd.summary_share(bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["methods"], MONTH))


@check("bar_pct", views("access", f"""WITH g AS ({groups('access', 'request_headers_accept_encoding')}),
    t AS ({top_and_totals('g', 10)})
    SELECT kind, dim, cnt, cnt_ok / cnt * 100 AS pct_ok, cnt_4xx / cnt * 100 AS pct_4xx,
           cnt_5xx / cnt * 100 AS pct_5xx,
           cnt / (SELECT max(cnt) FROM t WHERE kind = 'value' AND dim <> '') * 100 AS pct_bar FROM t"""))
def _(spark, sf):
    facet = replace(DELIVERY.facets["accept-encoding"], extra=None)
    return bd.bar_percentages(bd.breakdown(v.access(spark, sf), DELIVERY, facet, MONTH))


@check("join_missing_values", views("access", f"""
    WITH g AS ({groups('access', 'request_url')}), f AS ({groups('access', 'request_url', MONTH_WHERE + " AND request_method = 'GET'")}),
    top AS (SELECT * FROM f ORDER BY cnt DESC, dim LIMIT 5)
    SELECT 'value' AS kind, dim, {', '.join(COUNTERS)} FROM top
    UNION ALL SELECT 'total', NULL, {resum(COUNTERS)} FROM f
    UNION ALL SELECT 'selected', dim, {', '.join(COUNTERS)} FROM g
      WHERE dim IN ('/click/1.js', '/error/3.html', '/view/6.html') AND dim NOT IN (SELECT dim FROM top)"""))
def _(spark, sf):
    facet = DELIVERY.facets["paths"]
    chosen = tuple(facet.filter(x) for x in ("/click/1.js", "/error/3.html", "/view/6.html"))
    other = DELIVERY.facets["methods"].filter("GET")
    return bd.missing_selected(v.access(spark, sf), DELIVERY, facet,
                               replace(MONTH, top=5, filters=(*chosen, other)))


# --- counters ---------------------------------------------------------------

_BYTES = "response_headers_content_length"


@check("agg_status", views("access", " UNION ALL ".join(
    f"SELECT '{name}' AS mode, {counters(amount)} FROM access WHERE {MONTH_WHERE}"
    for name, amount in (("rows", "1"), ("weight", "weight"), ("bytes", _BYTES), ("bytes_weight", f"{_BYTES} * weight")))))
def _(spark, sf):
    rows = v.access(spark, sf).filter(p.in_range(v.access(spark, sf), v.MONTH))
    modes = (("rows", UNWEIGHTED, False), ("weight", DELIVERY, False),
             ("bytes", UNWEIGHTED, True), ("bytes_weight", DELIVERY, True))
    parts = [rows.agg(*traffic_counters(t, b)).select(F.lit(n).alias("mode"), "*") for n, t, b in modes]
    return reduce(DataFrame.unionByName, parts)


@check("agg_custom", views("worker", sql_breakdown("worker", "script_name", n=10, amount="1", conditions=OUTCOME_COUNTERS)))
def _(spark, sf):
    return bd.breakdown(v.worker(spark, sf), MIXER, MIXER.facets["script-name"], MONTH)


@check("agg_dim_count", views("access", """
    SELECT cdn_datacenter AS dim, CAST(sum(weight) AS BIGINT) AS weighted, count(*) AS rows FROM access GROUP BY 1"""))
def _(spark, sf):
    return v.access(spark, sf).groupBy(F.col("cdn_datacenter").alias("dim")).agg(
        dim_count(DELIVERY).alias("weighted"), dim_count(UNWEIGHTED).alias("rows"))


@check("agg_bytes_breakdown", views("access", sql_breakdown("access", "response_headers_content_type", n=10, amount=f"{_BYTES} * weight")))
def _(spark, sf):
    return bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["content-types"], replace(MONTH, by_bytes=True))


@check("status_class", views("access", f"""
    SELECT CASE WHEN response_status < 400 THEN 'ok' WHEN response_status < 500 THEN '4xx' ELSE '5xx' END AS class,
           count(*) AS cnt FROM access GROUP BY 1"""))
def _(spark, sf):
    status = classify.status_class(F.col("response_status"))
    names = F.create_map(*[F.lit(x) for x in ("ok", "ok", "client-error", "4xx", "server-error", "5xx")])
    return v.access(spark, sf).groupBy(names[status].alias("class")).agg(F.count(F.lit(1)).alias("cnt"))


@check("level_class", views("app_log", f"SELECT {counters('1', LEVEL_COUNTERS)} FROM app_log"))
def _(spark, sf):
    return v.app_log_in(spark, sf).agg(*traffic_counters(APP_LOGS))


@check("outcome_class", views("worker", f"SELECT {counters('1', OUTCOME_COUNTERS)} FROM worker"))
def _(spark, sf):
    return v.worker(spark, sf).agg(*traffic_counters(AUTHORING_WORKERS))


# --- predicates -------------------------------------------------------------

def _counted(name: str, view: str, where: str):
    """Compare the rows a predicate keeps: their number and weight by status."""
    amount = "weight" if view == "access" else "1"
    return check(name, views(view, f"SELECT response_status, count(*) AS n, CAST(sum({amount}) AS BIGINT) AS w "
                                   f"FROM {view} WHERE {where} GROUP BY 1"))


def _count(df: DataFrame, amount: str = "weight") -> DataFrame:
    return df.groupBy("response_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(amount)).cast("bigint").alias("w"))


@_counted("flt_time", "access", "date_trunc('minute', timestamp) BETWEEN TIMESTAMP '2024-01-05 10:07:00' AND TIMESTAMP '2024-01-19 23:59:00'")
def _(spark, sf):
    df = v.access(spark, sf)
    rng = TimeRange.free(datetime(2024, 1, 5, 10, 7, 41), datetime(2024, 1, 19, 23, 59, 2))
    return _count(df.filter(p.in_range(df, rng)))


@check("range_preset", views("access", " UNION ALL ".join(
    f"SELECT '{k}' AS preset, count(*) AS n FROM access WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00' - "
    f"to_seconds({int(period.total_seconds())}) AND timestamp < TIMESTAMP '2024-01-30 12:01:00'"
    for k, (period, _) in RANGE_PRESETS.items())))
def _(spark, sf):
    df = v.access(spark, sf)
    as_of = datetime(2024, 1, 30, 12)
    counts = df.agg(*[F.count_if(p.in_range(df, TimeRange.preset(k, as_of))).alias(k) for k in RANGE_PRESETS])
    return counts.unpivot([], list(RANGE_PRESETS), "preset", "n")


@_counted("flt_recent", "access", "timestamp > TIMESTAMP '2024-01-24 00:00:00'")
def _(spark, sf):
    df = v.access(spark, sf)
    return _count(df.filter(p.newer_than(df, timedelta(days=7), v.AS_OF)))


@_counted("flt_host", "access", "(contains(request_host, 'site1') OR contains(request_headers_x_forwarded_host, 'site1')) AND " + MONTH_WHERE)
def _(spark, sf):
    df = v.access(spark, sf)
    return _count(df.filter(p.page_filter(df, DELIVERY, replace(MONTH, host="site1"))))


@_counted("flt_host_column", "access", "contains(request_url, 'click/1') AND " + MONTH_WHERE)
def _(spark, sf):
    df = v.access(spark, sf)
    return _count(df.filter(p.page_filter(df, BACKEND, replace(MONTH, host="click/1"))))


_OR = "platform_owner", "platform_repo"


@check("flt_owner_repo", views("access", """
    SELECT 'exact' AS form, count(*) AS n FROM access WHERE platform_owner = 'org3' AND platform_repo = 'Site13'
    UNION ALL SELECT 'both', count(*) FROM access WHERE contains(platform_owner, 'rg3') AND contains(platform_repo, 'ite1')
    UNION ALL SELECT 'either', count(*) FROM access WHERE contains(platform_owner, '3') OR contains(platform_repo, '3')"""))
def _(spark, sf):
    df = v.access(spark, sf)
    forms = {"exact": p.owner_repo_matches("org3/Site13", *_OR, exact=True),
             "both": p.owner_repo_matches("rg3/ite1", *_OR), "either": p.owner_repo_matches("3", *_OR)}
    return df.agg(*[F.count_if(c).alias(n) for n, c in forms.items()]).unpivot([], list(forms), "form", "n")


@check("flt_search", views("app_log", """
    SELECT level, count(*) AS n FROM app_log WHERE contains(message, 'the') GROUP BY 1"""))
def _(spark, sf):
    df = v.app_log_in(spark, sf)
    hit = p.search_matches("the", APP_LOGS.message, APP_LOGS.request_id)
    return df.filter(hit).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@_counted("flt_facets", "access",
          "(request_method = 'GET' OR request_method = 'PUT') AND client_asn = 7 AND response_headers_x_error NOT LIKE '%load /%' "
          "AND platform_ref <> 'dev' AND " + MONTH_WHERE)
def _(spark, sf):
    df = v.access(spark, sf)
    f = DELIVERY.facets
    filters = (f["methods"].filter("GET"), f["methods"].filter("PUT"), f["asn"].filter("7 net 7"),
               f["errors"].filter("load /...", exclude=True), f["ref"].filter("dev", exclude=True),
               FacetFilter("no_such_column", "x"), FacetFilter("request_method", "GET", op="~"))
    filters = tuple(replace(x, filter_value="%load /%") if x.op == "LIKE" else x for x in filters)
    return _count(df.filter(p.page_filter(df, DELIVERY, replace(MONTH, filters=filters))))


@check("flt_has", views("worker", "SELECT script_name, count(*) AS n FROM worker WHERE list_contains(logs, 'log 1') "
                        "AND NOT list_contains(exceptions, 'boom') GROUP BY 1"))
def _(spark, sf):
    f = AUTHORING_WORKERS.facets
    kept = p.facet_filters([f["logs"].filter("log 1"), f["exceptions"].filter("boom", exclude=True)])
    return v.worker(spark, sf).filter(kept).groupBy("script_name").agg(F.count(F.lit(1)).alias("n"))


@check("flt_exclude_self", views("access", sql_breakdown(
    "access", "request_method", MONTH_WHERE + " AND platform_ref = 'main'", n=10,
    summary="request_method IN ('POST', 'PUT', 'PATCH', 'DELETE')")))
def _(spark, sf):
    f = DELIVERY.facets
    query = replace(MONTH, filters=(f["methods"].filter("GET"), f["ref"].filter("main")))
    return bd.breakdown(v.access(spark, sf), DELIVERY, f["methods"], query)


@check("flt_extra", views("access", sql_breakdown("access", "platform_ref", MONTH_WHERE + " AND platform_ref <> ''", n=10)))
def _(spark, sf):
    return bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["ref"], MONTH)


@check("flt_where", views("access", sql_breakdown("access", "source", MONTH_WHERE + " AND cdn_is_edge", n=10, summary="source = 'fastly'")))
def _(spark, sf):
    return bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["source"], replace(MONTH, where="cdn_is_edge"))


@_counted("flt_in", "access", "request_url IN ('/click/1.js', '/view/3.html')")
def _(spark, sf):
    return _count(v.access(spark, sf).filter(F.col("request_url").isin("/click/1.js", "/view/3.html")))


_UNWANTED = " AND ".join(f"request_headers_x_forwarded_host NOT LIKE '{x}'" for x in (
    "%.example.page", "localhost%", "%.workers.dev%", "%<%", "%{%", "%/%", "%oast%"))


@_counted("flt_like_set", "access", "request_host LIKE '%.example.live' AND request_headers_x_forwarded_host <> '' "
          f"AND request_headers_x_forwarded_host <> request_host AND {_UNWANTED}")
def _(spark, sf):
    return _count(v.access(spark, sf).filter(customer_traffic(Platform())))


@check("flt_category", views("access", """
    SELECT category, count(*) AS n FROM (SELECT unnest(['red', 'yellow', 'green', 'any']) AS category, response_status FROM access)
    WHERE CASE category WHEN 'red' THEN response_status >= 500 WHEN 'yellow' THEN response_status BETWEEN 400 AND 499
               WHEN 'green' THEN response_status < 400 ELSE true END GROUP BY 1"""))
def _(spark, sf):
    names = ("red", "yellow", "green", "any")
    return (v.access(spark, sf).agg(*[F.count_if(p.category_matches(c)).alias(c) for c in names])
            .unpivot([], list(names), "category", "n"))


# --- facets -----------------------------------------------------------------

def _one_facet_sql(view: str, facet, amount: str, conditions, n: int) -> str:
    dim = f"unnest({facet.dim})" if facet.is_array else duck_dim(facet)
    summary = DUCK_SUMMARIES.get(facet.name, facet.summary)
    body = groups(view, dim, duck_where(facet), amount=amount, conditions=conditions, summary=summary)
    names = ", ".join([*COUNTERS, "summary_cnt" if summary else "CAST(NULL AS BIGINT) AS summary_cnt"])
    return (f"(WITH g AS ({body}) SELECT '{facet.name}' AS facet, kind, dim, {names} FROM "
            f"({top_and_totals('g', n, other=True, summary=bool(summary))}))")


def _all_facets(name: str, view: str, table: LogTable, load, amount: str = "1"):
    facets = [f for f in table.facets.values() if not f.buckets]

    @check(name, views(view, " UNION ALL ".join(
        _one_facet_sql(view, f, amount, conditions_of(table), MONTH.top) for f in facets)))
    def _(spark, sf):
        return bd.all_facets(load(spark, sf), table, facets, MONTH, with_other=True)


def _enriched(spark, sf) -> DataFrame:
    return with_entities(v.app_log_in(spark, sf))


_all_facets("facets_delivery", "access", DELIVERY, v.access, "weight")
_all_facets("facets_authoring", "access", AUTHORING, v.access, "weight")
_all_facets("facets_workers", "worker", AUTHORING_WORKERS, v.worker)
_all_facets("facets_mixer", "worker", MIXER, v.worker)

_ENTITIES_SQL = """(SELECT *, regexp_extract_all(message, 'https?://[^\\s''"}>\\\\]+') AS urls,
    regexp_extract_all(message, '/[a-zA-Z0-9._%-]+(?:/[a-zA-Z0-9._%-]+)+') AS paths,
    regexp_extract_all(message, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS emails,
    regexp_extract_all(message, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b') AS ips FROM app_log)"""


def _app_log_facets():
    facets = [f for f in APP_LOGS.facets.values() if not f.buckets]
    sql = " UNION ALL ".join(_one_facet_sql("lines", f, "1", LEVEL_COUNTERS, MONTH.top) for f in facets)

    @check("facets_app_logs", views("app_log", f"WITH lines AS (SELECT * FROM {_ENTITIES_SQL}) SELECT * FROM ({sql})"))
    def _(spark, sf):
        return bd.all_facets(_enriched(spark, sf), APP_LOGS, facets, MONTH, with_other=True)


_app_log_facets()


_PART = "timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-12 00:01:00'"
_PREVIEWED = ("status-range", "methods", "tier", "errors")


def _page_facet_sql(name: str, where: str, n: int = 10, other: bool = False, bucket: str = "") -> str:
    """One facet of a delivery page: its groups, its top rows and totals."""
    facet = DELIVERY.facets[name]
    summary = facet.summary
    names = ", ".join([*COUNTERS, "summary_cnt" if summary else "CAST(NULL AS BIGINT) AS summary_cnt"])
    where = duck_where(facet, where)
    if bucket:
        body = f"SELECT {bucket} AS dim, {counters(summary=summary)}, min({facet.raw}) AS low FROM access WHERE {where} GROUP BY 1"
        return f"(WITH g AS ({body}) SELECT '{name}' AS facet, kind, dim, {names} FROM ({top_and_totals('g', n, 'low', summary=bool(summary))}))"
    body = groups("access", duck_dim(facet), where, summary=summary)
    return f"(WITH g AS ({body}) SELECT '{name}' AS facet, kind, dim, {names} FROM ({top_and_totals('g', n, other=other, summary=bool(summary))}))"


_ASN_PREVIEW = (
    f"(WITH g AS (SELECT CAST(client_asn AS VARCHAR) || ' ' || coalesce(n_name, '') AS dim, CAST(client_asn AS VARCHAR) AS asn, {counters()} "
    f"FROM access LEFT JOIN nation ON client_asn = n_nationkey WHERE {_PART} AND client_asn <> 0 GROUP BY 1, 2) "
    f"SELECT 'asn' AS facet, kind, dim, {', '.join(COUNTERS)}, CAST(NULL AS BIGINT) AS summary_cnt FROM "
    f"({top_and_totals('g', 10, 'cnt DESC, asn').replace('SELECT * FROM g', 'SELECT dim, cnt, cnt_ok, cnt_4xx, cnt_5xx FROM g')}))")
# Ten rows: nine bounds of the response times, spread evenly over the list of bounds.
_ELAPSED_TEN = """CASE WHEN cdn_time_elapsed_msec < 1 THEN '< 1ms' WHEN cdn_time_elapsed_msec < 5 THEN '1ms-5ms' WHEN cdn_time_elapsed_msec < 20 THEN '5ms-20ms'
    WHEN cdn_time_elapsed_msec < 70 THEN '20ms-70ms' WHEN cdn_time_elapsed_msec < 300 THEN '70ms-300ms' WHEN cdn_time_elapsed_msec < 1000 THEN '300ms-1s'
    WHEN cdn_time_elapsed_msec < 3000 THEN '1s-3s' WHEN cdn_time_elapsed_msec < 15000 THEN '3s-15s' WHEN cdn_time_elapsed_msec < 60000 THEN '15s-60s' ELSE '≥ 60s' END"""


def _names(spark, sf) -> DataFrame:
    return v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("asn"), F.col("n_name").alias("name"))


@check("breakdown_preview", views("access", " UNION ALL ".join(
    [*[_page_facet_sql(n, _PART) for n in _PREVIEWED], _ASN_PREVIEW, _page_facet_sql("time-elapsed", _PART, bucket=_ELAPSED_TEN)])))
def _(spark, sf):
    facets = [DELIVERY.facets[n] for n in (*_PREVIEWED, "asn", "time-elapsed")]
    part = TimeRange.free(datetime(2024, 1, 10), datetime(2024, 1, 12))
    return bd.preview(v.access(spark, sf), DELIVERY, facets, MONTH, part, _names(spark, sf))


_FROM_ROLLUP = ("status-range", "methods", "tier", "datacenters", "source")
_FROM_ROWS = ("paths", "referers")


def _rolled_page(spark, sf) -> Page:
    rows = v.access(spark, sf)
    return Page(DELIVERY, rows, _stored(spark, minute_rollup(rows, DELIVERY, CDN_ROLLUP)), rollup_day="dt")


@check("page_rollup", views("access", " UNION ALL ".join(
    [*[_page_facet_sql(n, MONTH_WHERE, other=True) for n in (*_FROM_ROLLUP, *_FROM_ROWS)], _page_facet_sql("time-elapsed", MONTH_WHERE, bucket=_ELAPSED_TEN)])))
def _(spark, sf):
    return _rolled_page(spark, sf).breakdowns(MONTH, (*_FROM_ROLLUP, *_FROM_ROWS, "time-elapsed"))


@check("preview_rollup", views("access", " UNION ALL ".join(_page_facet_sql(n, _PART, other=True) for n in (*_FROM_ROLLUP, *_FROM_ROWS))))
def _(spark, sf):
    part = TimeRange.free(datetime(2024, 1, 10), datetime(2024, 1, 12))
    return _rolled_page(spark, sf).breakdowns(MONTH, (*_FROM_ROLLUP, *_FROM_ROWS), part=part)


_CHOSEN = ("main--site7--org2.example.live", "3 NATION_3")
_CHOSEN_BOTH = f"request_host = '{_CHOSEN[0]}' AND client_asn = 3"


def _selected_sql(facet: str, dim: str, others: str, value: str, extra: str = "true", joined: str = "access") -> str:
    """Top rows under the other facets' filters; the value itself, if not among them, under none."""
    top = groups(joined, dim, f"{MONTH_WHERE} AND {extra} AND {others}")
    every = groups(joined, dim, f"{MONTH_WHERE} AND {extra}")
    null = "CAST(NULL AS BIGINT) AS summary_cnt"
    summary = DELIVERY.facets[facet].summary
    if summary:
        top, every, null = groups(joined, dim, f"{MONTH_WHERE} AND {extra} AND {others}", summary=summary), groups(joined, dim, f"{MONTH_WHERE} AND {extra}", summary=summary), "summary_cnt"
    names = ", ".join([*COUNTERS, null])
    return (f"(WITH g AS ({top}), e AS ({every}), page AS ({top_and_totals('g', 3, other=True, summary=bool(summary))}) "
            f"SELECT '{facet}' AS facet, kind, dim, {names} FROM page UNION ALL SELECT '{facet}', 'selected', dim, {names} FROM e "
            f"WHERE dim = '{value}' AND dim NOT IN (SELECT dim FROM page WHERE kind = 'value'))")


@check("page_selected", views("access", " UNION ALL ".join([
    _selected_sql("hosts", "request_host", "client_asn = 3", _CHOSEN[0]),
    _selected_sql("asn", "CAST(client_asn AS VARCHAR) || ' ' || coalesce(n_name, '')", f"request_host = '{_CHOSEN[0]}'", _CHOSEN[1], "client_asn <> 0",
                  "access LEFT JOIN nation ON client_asn = n_nationkey"),
    _selected_sql("methods", "request_method", _CHOSEN_BOTH, "-")])))
def _(spark, sf):
    filters = (DELIVERY.facets["hosts"].filter(_CHOSEN[0]), DELIVERY.facets["asn"].filter(_CHOSEN[1]))
    page = Page(DELIVERY, v.access(spark, sf), names=_names(spark, sf))
    return page.breakdowns(replace(MONTH, top=3, filters=filters), ("hosts", "asn", "methods"))


def _bucket_case(facet, n: int) -> str:
    return facet.buckets(n, "raw")


def _bucketed(name: str, view: str, table: LogTable, facet_name: str, load, n: int, amount: str = "weight",
              summary: str | None = None):
    facet = table.facets[facet_name]
    raw = duck_dim(facet)
    inner = (f"SELECT {raw} AS raw, {counters(amount, conditions_of(table), summary)} FROM {view} "
             f"WHERE {duck_where(facet)} GROUP BY 1")
    names = COUNTERS + (["summary_cnt"] if summary else [])
    sql = (f"WITH i AS ({inner}), g AS (SELECT {_bucket_case(facet, n)} AS dim, {resum(names)}, min(raw) AS low FROM i GROUP BY 1) "
           + top_and_totals("g", n, "low, dim", summary=bool(summary)))

    @check(name, views(view, sql))
    def _(spark, sf):
        return bd.breakdown(load(spark, sf), table, facet, replace(MONTH, top=n))


_bucketed("bucket_content_length", "access", DELIVERY, "content-length", v.access, 10)
_bucketed("bucket_time_elapsed", "access", DELIVERY, "time-elapsed", v.access, 10, summary="cdn_time_elapsed_msec >= 1000")
_bucketed("bucket_ratelimit", "access", ADMIN, "ratelimit-rate", v.access, 5)
_bucketed("bucket_delivery_ratelimit", "access", DELIVERY, "delivery-ratelimit-rate", v.access, 10)
_bucketed("breakdown_bucketed", "access", DELIVERY, "content-length", v.access, 20)
_bucketed("bucket_admin_duration", "app_log", APP_LOGS, "admin-duration", _enriched, 10, amount="1",
          summary=DUCK_DIMS["admin-duration"] + " >= 1000")


@check("join_fill_labels", views("access", f"""
    WITH labels AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(bk.elapsed_labels(20)))}) l(idx, dim)),
    g AS (SELECT {bk.elapsed_buckets(20, 'cdn_time_elapsed_msec')} AS dim, {counters()} FROM access WHERE {MONTH_WHERE} GROUP BY 1)
    SELECT idx, dim, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COUNTERS)} FROM labels LEFT JOIN g USING (dim)"""))
def _(spark, sf):
    facet = replace(DELIVERY.facets["time-elapsed"], summary=None)
    result = bd.breakdown(v.access(spark, sf), DELIVERY, facet, replace(MONTH, top=20))
    return bd.fill_labels(result, facet.labels(20))


@check("facet_array", views("worker", sql_breakdown("worker", "unnest(logs)", n=10, amount="1", conditions=OUTCOME_COUNTERS)))
def _(spark, sf):
    return bd.breakdown(v.worker(spark, sf), MIXER, MIXER.facets["logs"], MONTH)


@check("join_asn_dict", views("access", f"""
    WITH g AS (SELECT CAST(client_asn AS VARCHAR) || ' ' || coalesce(n_name, '') AS dim, {counters()}
               FROM access LEFT JOIN nation ON client_asn = n_nationkey WHERE {MONTH_WHERE} AND client_asn <> 0 GROUP BY 1)
    {top_and_totals('g', 100)}"""))
def _(spark, sf):
    names = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("asn"), F.col("n_name").alias("name"))
    return bd.dictionary_breakdown(v.access(spark, sf), names, DELIVERY, DELIVERY.facets["asn"], replace(MONTH, top=100))


# --- roll-up ----------------------------------------------------------------

def _rollup_sql(view: str, facets: dict[str, str], amount: str, conditions) -> str:
    parts = [f"SELECT date_trunc('minute', timestamp) AS minute, '{n}' AS facet, coalesce({d}, '') AS dim, {counters(amount, conditions)} "
             f"FROM {view} GROUP BY 1, 2, 3" for n, d in facets.items()]
    return " UNION ALL ".join(parts)


_CDN_DUCK = {**CDN_ROLLUP, "status_range": DUCK_STATUS_RANGE, "x_error_grouped": DUCK_ERROR}
_APP_DUCK = {**APP_LOG_ROLLUP, "function_name": DUCK_DIMS["function-name"],
             "function_version": DUCK_DIMS["function-version"], "admin_method": DUCK_DIMS["admin-method"]}


@check("rollup_cdn", views("access", _rollup_sql("access", _CDN_DUCK, "weight", STATUS_COUNTERS)))
def _(spark, sf):
    return minute_rollup(v.access(spark, sf), DELIVERY, CDN_ROLLUP)


@check("rollup_lambda", views("app_log", _rollup_sql("app_log", _APP_DUCK, "1", LEVEL_COUNTERS)))
def _(spark, sf):
    return minute_rollup(_enriched(spark, sf), APP_LOGS, APP_LOG_ROLLUP)


def _stored(spark, rollup: DataFrame) -> DataFrame:
    """The roll-up as it is used: written once, read by day."""
    path = shared_folder(spark, "rollup")
    write_facts(rollup, path, time="minute", sort=("facet",))
    return spark.read.parquet(path)


@check("breakdown_rollup", views("access", sql_breakdown(
    "access", "platform_contentbus_prefix", MONTH_WHERE + " AND platform_contentbus_prefix <> ''", n=10,
    summary="platform_contentbus_prefix = 'live'", other=True)))
def _(spark, sf):
    rollup = _stored(spark, minute_rollup(v.access(spark, sf), DELIVERY, CDN_ROLLUP))
    return bd.rollup_breakdown(rollup, DELIVERY.facets["tier"], MONTH, day="dt", with_other=True)


@check("breakdown_rollup_lambda", views("app_log", sql_breakdown(
    "app_log", "level", n=10, amount="1", conditions=LEVEL_COUNTERS, summary="lower(level) = 'error'")))
def _(spark, sf):
    rollup = _stored(spark, minute_rollup(_enriched(spark, sf), APP_LOGS, APP_LOG_ROLLUP))
    return bd.rollup_breakdown(rollup, APP_LOGS.facets["level"], MONTH, day="dt")


@check("flt_minute_range", views("access", f"""
    SELECT CAST(sum(weight) AS BIGINT) AS cnt FROM access
    WHERE date_trunc('minute', timestamp) BETWEEN TIMESTAMP '2024-01-03 04:05:00' AND TIMESTAMP '2024-01-20 06:07:00'"""))
def _(spark, sf):
    rollup = _stored(spark, minute_rollup(v.access(spark, sf), DELIVERY, {"method": "request_method"}))
    rng = TimeRange.free(datetime(2024, 1, 3, 4, 5, 59), datetime(2024, 1, 20, 6, 7, 1))
    return rollup.filter(p.minutes_between(rollup, rng, day="dt")).agg(F.sum("cnt").cast("bigint").alias("cnt"))


@check("rollup_router", views("access", f"""
    (WITH g AS ({groups('access', 'request_method', summary="request_method IN ('POST', 'PUT', 'PATCH', 'DELETE')")})
     SELECT 'methods' AS facet, * FROM ({top_and_totals('g', 10, summary=True)}))
    UNION ALL
    (WITH g AS ({groups('access', 'request_host', summary="request_host LIKE '%.example.live'")})
     SELECT 'hosts' AS facet, * FROM ({top_and_totals('g', 10, summary=True)}))"""))
def _(spark, sf):
    df = v.access(spark, sf)
    rollup = _stored(spark, minute_rollup(df, DELIVERY, CDN_ROLLUP))
    parts = [bd.pick_source(df, rollup, DELIVERY, DELIVERY.facets[n], MONTH, rollup_day="dt").select(F.lit(n).alias("facet"), "*")
             for n in ("methods", "hosts")]
    return reduce(DataFrame.unionByName, parts)


# --- time series ------------------------------------------------------------

def _series_sql(view: str, query: Query, conditions, amount: str = "1", where: str = "true",
                fill: bool = True) -> str:
    rng, step = query.range, int(query.range.step.total_seconds())
    data = (f"SELECT time_bucket(to_seconds({step}), timestamp, TIMESTAMP '1970-01-01') AS t, {counters(amount, conditions)} FROM {view} "
            f"WHERE timestamp >= TIMESTAMP '{rng.first_minute}' AND timestamp < TIMESTAMP '{rng.until}' AND {where} GROUP BY 1")
    classes = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTERS[1:])
    if not fill:
        return f"SELECT t, {classes} FROM ({data})"
    spine = (f"SELECT unnest(generate_series(TIMESTAMP '{rng.fill_from}', TIMESTAMP '{rng.fill_to - rng.step}', "
             f"to_seconds({step}))) AS t")
    return f"SELECT t, {classes} FROM ({data}) FULL JOIN ({spine}) USING (t)"


def _preset(key: str, as_of: datetime = v.AS_OF) -> Query:
    return Query(TimeRange.preset(key, as_of))


def _time_series(name: str, view: str, table: LogTable, load, query: Query, amount: str = "1", fill: bool = True):
    @check(name, views(view, _series_sql(view, query, conditions_of(table), amount, fill=fill)))
    def _(spark, sf):
        return ts.classes_over_time(load(spark, sf), table, query, fill=fill)


_time_series("ts_status", "access", UNWEIGHTED, v.access, Query(v.MONTH), fill=False)
_time_series("ts_status_delivery", "access", DELIVERY, v.access, _preset("14d"), "weight")
_time_series("ts_status_backend", "access", replace(BACKEND, hosts=()), v.access, _preset("7d"), "weight")
_time_series("ts_status_workers", "worker", AUTHORING_WORKERS, v.worker, _preset("14d"))
_time_series("ts_status_mixer", "worker", MIXER, v.worker, _preset("7d"))
_time_series("ts_status_lambda", "app_log", APP_LOGS, v.app_log_in, Query(v.MONTH))
_time_series("ts_gapfill", "access", DELIVERY, v.access, Query(TimeRange.free(datetime(2024, 1, 9, 11, 34, 56), datetime(2024, 1, 10, 9, 34, 56))), "weight")


@check("ts_bucket", views("access", " UNION ALL ".join(
    f"SELECT '{k}' AS preset, time_bucket(to_seconds({int(step.total_seconds())}), timestamp, TIMESTAMP '1970-01-01') AS t, count(*) AS n FROM access GROUP BY 2"
    for k, (_, step) in RANGE_PRESETS.items())))
def _(spark, sf):
    df = v.access(spark, sf)
    parts = [df.groupBy(ts.bucket("timestamp", step).alias("t")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(k).alias("preset"), "t", "n") for k, (_, step) in RANGE_PRESETS.items()]
    return reduce(DataFrame.unionByName, parts)


_SPANS = [timedelta(minutes=15), timedelta(minutes=60), timedelta(hours=12), timedelta(hours=24), timedelta(hours=25)]


@check("ts_bucket_custom", views("access", " UNION ALL ".join(
    "SELECT {0} AS span, * FROM ({1})".format(int(span.total_seconds()), _series_sql(
        "access", Query(TimeRange.free(datetime(2024, 1, 15), datetime(2024, 1, 15) + span)), STATUS_COUNTERS, "weight"))
    for span in _SPANS)))
def _(spark, sf):
    df = v.access(spark, sf)
    parts = [ts.classes_over_time(df, DELIVERY, Query(TimeRange.free(datetime(2024, 1, 15), datetime(2024, 1, 15) + span)))
             .select(F.lit(int(span.total_seconds())).alias("span"), "t", *ts.CLASSES) for span in _SPANS]
    return reduce(DataFrame.unionByName, parts)


_FILLED_AS_OF = datetime(2024, 1, 30, 12, 34, 56)


@check("ts_fill_bounds", views("access", " UNION ALL ".join(
    f"SELECT '{k}' AS preset, min(t) AS first, max(t) AS last, count(*) AS buckets, CAST(sum(cnt_ok + cnt_4xx + cnt_5xx) AS BIGINT) AS total "
    f"FROM ({_series_sql('access', _preset(k, _FILLED_AS_OF), STATUS_COUNTERS, 'weight')})" for k in RANGE_PRESETS)))
def _(spark, sf):
    df = v.access(spark, sf)
    parts = []
    for k in RANGE_PRESETS:
        series = ts.classes_over_time(df, DELIVERY, _preset(k, _FILLED_AS_OF))
        total = F.sum(F.col("cnt_ok") + F.col("cnt_4xx") + F.col("cnt_5xx")).cast("bigint").alias("total")
        parts.append(series.agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("buckets"), total)
                     .select(F.lit(k).alias("preset"), "*"))
    return reduce(DataFrame.unionByName, parts)


@check("ts_gapfill_by_key", views("access", f"""
    WITH d AS (SELECT platform_org, time_bucket(to_seconds(600), timestamp, TIMESTAMP '1970-01-01') AS t, {counters()} FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2),
    spine AS (SELECT platform_org, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:50:00', to_seconds(600))) AS t FROM (SELECT DISTINCT platform_org FROM d))
    SELECT platform_org, t, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in COUNTERS[1:])} FROM d FULL JOIN spine USING (platform_org, t)"""))
def _(spark, sf):
    return ts.classes_over_time(v.access(spark, sf), DELIVERY, MONTH, keys=["platform_org"])


@check("ts_stack", views("access", f"""
    SELECT *, cnt_ok AS stack_ok, cnt_ok + cnt_4xx AS stack_4xx, cnt_ok + cnt_4xx + cnt_5xx AS stack_5xx
    FROM ({_series_sql('access', _preset('7d'), STATUS_COUNTERS, 'weight')})"""))
def _(spark, sf):
    return ts.stacked(ts.classes_over_time(v.access(spark, sf), DELIVERY, _preset("7d")))


@check("chart_total", views("access", f"""
    SELECT CAST(sum(cnt_ok + cnt_4xx + cnt_5xx) AS BIGINT) AS total,
           greatest(4, CAST(ceil(max(cnt_ok + cnt_4xx + cnt_5xx) / 4.0) * 4 AS BIGINT)) AS y_max
    FROM ({_series_sql('access', _preset('14d'), STATUS_COUNTERS, 'weight')})"""))
def _(spark, sf):
    return ts.chart_total(ts.classes_over_time(v.access(spark, sf), DELIVERY, _preset("14d")))


@check("ts_tail20", views("access", f"""
    WITH s AS (SELECT platform_org, time_bucket(to_seconds(600), timestamp, TIMESTAMP '1970-01-01') AS t FROM access WHERE {MONTH_WHERE} GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY platform_org ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY platform_org) AS n FROM s)
    SELECT platform_org, min(t) AS start, max(t) AS "end" FROM i WHERE n >= 2 AND i >= floor(n * 0.8) GROUP BY 1"""))
def _(spark, sf):
    series = ts.classes_over_time(v.access(spark, sf), DELIVERY, MONTH, keys=["platform_org"], fill=False)
    return ts.last_fifth(series, ["platform_org"])


# Ranges from pairs of event times: forwards, backwards, wide and narrow.
_MS = "CAST(floor(value * 1000) AS BIGINT)"


@check("range_snap", f"""
    WITH r AS (SELECT event_id, ts AS a, ts + to_milliseconds(CASE WHEN event_id % 2 = 0 THEN {_MS} ELSE -{_MS} END) AS b FROM events),
    m AS (SELECT event_id, epoch_us(least(a, b)) // 60000000 AS s,
                 CAST(ceil(epoch_us(greatest(a, b)) / 60000000.0) AS BIGINT) AS e FROM r),
    n AS (SELECT event_id, s, greatest(e, s + 1) AS e FROM m)
    SELECT event_id,
           make_timestamp(60000000 * CASE WHEN e - s < 3 THEN CAST(floor((s + e) / 2.0 - 1.5) AS BIGINT) ELSE s END) AS start,
           make_timestamp(60000000 * CASE WHEN e - s < 3 THEN CAST(ceil((s + e) / 2.0 + 1.5) AS BIGINT) ELSE e END) AS "end"
    FROM n""")
def _(spark, sf):
    ms = F.floor(F.col("value") * 1000).cast("bigint")
    shift = F.when(F.col("event_id") % 2 == 0, ms).otherwise(-ms)
    other = (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=shift / 1000)).cast("timestamp_ntz")
    ranges = v.events(spark, sf).select("event_id", F.col("ts").alias("start"), other.alias("end"))
    return ts.snap_ranges(ranges)


# One range per customer, some backwards, over the month of traffic.
@check("range_counters", views("access", f"""
    WITH r AS (SELECT c_custkey, TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 37 % 41000) AS a,
                      TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 91 % 41000) AS b FROM customer),
    n AS (SELECT c_custkey, least(a, b) AS s, greatest(a, b) AS e FROM r),
    w AS (SELECT c_custkey, CASE WHEN e - s < INTERVAL 3 MINUTE THEN 1 ELSE 0 END AS narrow, s, e FROM n),
    f AS (SELECT c_custkey, CASE WHEN narrow = 0 THEN s ELSE to_timestamp(CAST(floor((epoch(s) + greatest(epoch(e), epoch(s) + 60)) / 120 - 1.5) AS BIGINT) * 60)::TIMESTAMP END AS s,
                 CASE WHEN narrow = 0 THEN e ELSE to_timestamp(CAST(ceil((epoch(s) + greatest(epoch(e), epoch(s) + 60)) / 120 + 1.5) AS BIGINT) * 60)::TIMESTAMP END AS e FROM w)
    SELECT c_custkey, {counters()} FROM f LEFT JOIN access ON timestamp >= s AND timestamp < e GROUP BY 1"""))
def _(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    ranges = v.table(spark, sf, "customer").select(
        "c_custkey", (start + F.expr("make_dt_interval(0, 0, CAST(c_custkey * 37 % 41000 AS INT), 0)")).alias("start"),
        (start + F.expr("make_dt_interval(0, 0, CAST(c_custkey * 91 % 41000 AS INT), 0)")).alias("end"))
    return ts.counters_in_ranges(v.access(spark, sf), DELIVERY, ts.snap_ranges(ranges), ["c_custkey"])


@check("bar_classes", views("access", f"""
    WITH g AS ({groups('access', "CASE WHEN response_headers_x_error = '' THEN '' ELSE 'content' END")}) {top_and_totals('g', 10)}"""))
def _(spark, sf):
    df = v.access(spark, sf).withColumn("error_kind", classify.error_class(F.col("response_headers_x_error")))
    facet = replace(DELIVERY.facets["route"], name="error-kind", dim="error_kind", extra=None)
    return bd.breakdown(df, DELIVERY, facet, MONTH)
