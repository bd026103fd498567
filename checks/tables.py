"""Listings, lookups, configurations, domains and classifiers."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from checks.sqltext import MONTH_WHERE
from tidegauge.functions import classify
from tidegauge.operators import configs, domains, listing, lookups
from tidegauge.operators import timeseries as ts
from tidegauge.plans.dashboards import AUTHORING_WORKERS, DELIVERY
from tidegauge.session import shared_folder
from tidegauge.sources import config_dump, snapshots
from tidegauge.spec import Query, TimeRange

MONTH = Query(v.MONTH, top=5)
TABLE = replace(DELIVERY, id="event_id")


def views(names: str, sql: str) -> str:
    return v.with_views(names, sql)


# --- listings ---------------------------------------------------------------

_PAGE = "event_id, timestamp, request_url, response_status"


@check("log_page", views("access", f"SELECT {_PAGE} FROM access WHERE {MONTH_WHERE} ORDER BY timestamp DESC, event_id DESC LIMIT 500"))
def _(spark, sf):
    return listing.log_page(v.access(spark, sf), TABLE, MONTH).select(*_PAGE.split(", "))


@check("log_page_more", views("access", f"SELECT {_PAGE} FROM access WHERE {MONTH_WHERE} ORDER BY timestamp DESC, event_id DESC LIMIT 500 OFFSET 500"))
def _(spark, sf):
    return listing.log_page(v.access(spark, sf), TABLE, MONTH, offset=500).select(*_PAGE.split(", "))


@check("log_page_counted", views("access", f"SELECT {_PAGE} FROM access WHERE {MONTH_WHERE} ORDER BY timestamp DESC, event_id DESC LIMIT 500 OFFSET 700"))
def _(spark, sf):
    """A deep page whose first minute comes from counts per minute; the counts come in two parts."""
    rows, odd = v.access(spark, sf), F.col("event_id") % 2 == 1
    counts = listing.minute_rows(rows.filter(odd), TABLE).unionByName(listing.minute_rows(rows.filter(~odd), TABLE))
    return listing.log_page(rows, TABLE, MONTH, offset=700, counts=counts).select(*_PAGE.split(", "))


@check("log_page_after", views("access", f"""SELECT {_PAGE} FROM access WHERE {MONTH_WHERE}
    AND (timestamp < TIMESTAMP '2024-01-15 12:00:00' OR (timestamp = TIMESTAMP '2024-01-15 12:00:00' AND event_id < 77))
    ORDER BY timestamp DESC, event_id DESC LIMIT 500"""))
def _(spark, sf):
    return listing.log_page(v.access(spark, sf), TABLE, MONTH, after=(datetime(2024, 1, 15, 12), 77)).select(*_PAGE.split(", "))


@check("facet_search_initial", views("access", f"""
    SELECT request_host AS dim, CAST(sum(weight) AS BIGINT) AS cnt FROM access WHERE {MONTH_WHERE}
    GROUP BY 1 ORDER BY cnt DESC, dim LIMIT 20 OFFSET 5"""))
def _(spark, sf):
    return listing.next_values(v.access(spark, sf), DELIVERY, DELIVERY.facets["hosts"], MONTH)


@check("facet_search_pattern", views("access", f"""
    SELECT request_url AS dim, CAST(sum(weight) AS BIGINT) AS cnt FROM access WHERE {MONTH_WHERE} AND contains(request_url, 'ck/1')
    GROUP BY 1 ORDER BY cnt DESC, dim LIMIT 20"""))
def _(spark, sf):
    return listing.values_containing(v.access(spark, sf), DELIVERY, DELIVERY.facets["paths"], MONTH, "ck/1")


@check("facet_search_array", views("worker", f"""
    SELECT unnest(logs) AS dim, count(*) AS cnt FROM worker WHERE {MONTH_WHERE} GROUP BY 1
    HAVING contains(dim, 'log') ORDER BY cnt DESC, dim LIMIT 20"""))
def _(spark, sf):
    return listing.values_containing(v.worker(spark, sf), AUTHORING_WORKERS, AUTHORING_WORKERS.facets["logs"], MONTH, "log")


_DAY = "timestamp > TIMESTAMP '2024-01-29'"
_AS_OF = datetime(2024, 1, 30)
_HOSTS = f"SELECT request_host AS host, count(*) AS cnt FROM access WHERE {_DAY} GROUP BY 1 ORDER BY cnt DESC, host LIMIT 100"
_FORWARDED = (f"SELECT request_headers_x_forwarded_host AS host, count(*) AS cnt FROM access WHERE {_DAY} "
              "AND request_headers_x_forwarded_host <> '' GROUP BY 1 ORDER BY cnt DESC, host LIMIT 100")


@check("autocomplete_hosts", views("access", _HOSTS))
def _(spark, sf):
    return listing.frequent_values(v.access(spark, sf), "request_host", _AS_OF)


@check("autocomplete_forwarded", views("access", _FORWARDED))
def _(spark, sf):
    return listing.frequent_values(v.access(spark, sf), "request_headers_x_forwarded_host", _AS_OF, non_empty=True)


@check("autocomplete_functions", views("app_log", """
    SELECT function_name AS host, count(*) AS cnt FROM app_log WHERE timestamp > TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1 ORDER BY cnt DESC, host LIMIT 100"""))
def _(spark, sf):
    return listing.frequent_values(v.app_log_in(spark, sf), "function_name", datetime(2024, 1, 2, 12))


@check("set_union_client", views("access", f"""
    SELECT host FROM (SELECT host FROM ({_HOSTS}) UNION SELECT trim(unnest(string_split(host, ','))) FROM ({_FORWARDED}))
    WHERE host <> '' ORDER BY host LIMIT 200"""))
def _(spark, sf):
    df = v.access(spark, sf)
    return listing.merged_hosts(
        listing.frequent_values(df, "request_host", _AS_OF),
        listing.frequent_values(df, "request_headers_x_forwarded_host", _AS_OF, non_empty=True))


_WEEK = "timestamp > TIMESTAMP '2024-01-24'"
_NAMES = f"""SELECT platform_owner AS owner_repo FROM access WHERE {_WEEK} AND platform_owner <> ''
    UNION SELECT platform_owner || '/' || platform_repo FROM access WHERE {_WEEK} AND platform_owner <> '' AND platform_repo <> ''"""


@check("autocomplete_owner_repo", views("access", _NAMES))
def _(spark, sf):
    return listing.owners_and_repos(v.access(spark, sf), DELIVERY, v.AS_OF)


@check("union_all_dedup", views("access", f"SELECT count(*) AS n FROM ({_NAMES})"))
def _(spark, sf):
    return listing.owners_and_repos(v.access(spark, sf), DELIVERY, v.AS_OF).agg(F.count(F.lit(1)).alias("n"))


@check("distinct_keys", views("access", f"SELECT DISTINCT platform_owner AS owner, platform_repo AS repo FROM access WHERE {_WEEK}"))
def _(spark, sf):
    return (v.access(spark, sf).filter("timestamp > timestamp_ntz'2024-01-24 00:00:00'")
            .select(F.col("platform_owner").alias("owner"), F.col("platform_repo").alias("repo")).distinct())


@check("suggest_rank", views("access", f"""
    SELECT owner_repo, CASE WHEN starts_with(lower(owner_repo), 'org1') THEN CASE WHEN contains(owner_repo, '/') THEN 1 ELSE 0 END ELSE 2 END AS rank
    FROM ({_NAMES}) WHERE contains(lower(owner_repo), 'org1') ORDER BY rank, lower(owner_repo), owner_repo LIMIT 20"""))
def _(spark, sf):
    return listing.ranked_suggestions(listing.owners_and_repos(v.access(spark, sf), DELIVERY, v.AS_OF), "Org1")


# --- domains ----------------------------------------------------------------

# What a forwarded host must not look like to be somebody's own domain.
_UNWANTED_HOSTS = ("%.example.page", "localhost%", "%.workers.dev%", "%<%", "%{%", "%/%", "%oast%")
_DOMAINS = f"""
  unwanted AS (SELECT unnest({list(_UNWANTED_HOSTS)}) AS pattern),
  named AS (
    SELECT timestamp, request_headers_x_byo_cdn_type AS cdn_type, request_headers_x_forwarded_host AS forwarded,
           string_split(left(request_host, length(request_host) - 13), '--') AS site,
           regexp_extract(lower(request_headers_x_forwarded_host), '^ *([^,: ]*?)[.]?(?:[:, ].*)?$', 1) AS domain
    FROM access WHERE ends_with(request_host, '.example.live') AND request_headers_x_forwarded_host NOT IN ('', request_host)),
  report AS (
    SELECT domain, site[3] AS owner, site[2] AS repo, cdn_type,
           round(count(*) / (1 + date_diff('hour', min(timestamp), max(timestamp))), 1) AS req_per_hour,
           count(*) AS total, date_diff('day', min(timestamp), DATE '2024-01-31') AS age_days
    FROM named
    WHERE timestamp > TIMESTAMP '2024-01-01' AND NOT EXISTS (SELECT 1 FROM unwanted WHERE forwarded LIKE pattern)
      AND regexp_matches(domain, '^[a-z0-9][a-z0-9.-]+[.][a-z][a-z]+$')
      AND NOT list_contains(['example.live', 'shop3.example.com'], domain) AND NOT ends_with(domain, '.example.reviews')
    GROUP BY ALL)"""
_PLATFORM = domains.Platform(own_domains=("example.live", "shop3.example.com"))


def _report(spark, sf) -> DataFrame:
    return domains.domain_report(v.access(spark, sf), _PLATFORM, v.AS_OF, age=timedelta(days=30))


@check("domains_report", views("access", f"WITH {_DOMAINS} SELECT * FROM report"))
def _(spark, sf):
    return _report(spark, sf)


@check("flt_having", views("access", """
    WITH named AS (SELECT regexp_extract(lower(request_headers_x_forwarded_host), '^ *([^,: ]*?)[.]?(?:[:, ].*)?$', 1) AS domain FROM access)
    SELECT domain, count(*) AS n FROM named
    WHERE regexp_matches(domain, '^[a-z0-9][a-z0-9.-]+[.][a-z][a-z]+$') AND NOT list_contains(['example.live', 'shop3.example.com'], domain)
      AND NOT ends_with(domain, '.example.reviews')
    GROUP BY domain"""))
def _(spark, sf):
    counts = (v.access(spark, sf).groupBy(domains.forwarded_domain("request_headers_x_forwarded_host").alias("domain"))
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.filter(domains.is_customer_domain(F.col("domain"), _PLATFORM))


@check("min_max_rate", views("access", f"WITH {_DOMAINS} SELECT sum(total)::BIGINT AS total, round(sum(req_per_hour), 3) AS rate, max(age_days) AS oldest FROM report"))
def _(spark, sf):
    return _report(spark, sf).agg(F.sum("total").cast("bigint").alias("total"), F.round(F.sum("req_per_hour"), 3).alias("rate"),
                                  F.max("age_days").alias("oldest"))


@check("flt_domain_text", views("access", f"WITH {_DOMAINS} SELECT *, age_days <= 1 AS is_new FROM report WHERE contains(domain, 'shop1') OR contains(owner, 'shop1') OR contains(repo, 'shop1')"))
def _(spark, sf):
    return domains.domain_listing(_report(spark, sf), "domain", True, "Shop1")


@check("sort_domains", views("access", f"WITH {_DOMAINS} SELECT *, age_days <= 1 AS is_new FROM report ORDER BY lower(repo), total DESC, domain, owner, repo, cdn_type"))
def _(spark, sf):
    return domains.domain_listing(_report(spark, sf), "repo", True)


# --- latest versions and configurations -------------------------------------

@check("scan_latest", """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    return lookups.latest(v.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


_LATEST = """
  sites AS (SELECT * FROM site_versions QUALIFY row_number() OVER (PARTITION BY org, site ORDER BY _version DESC) = 1),
  profiles AS (SELECT * FROM profile_versions QUALIFY row_number() OVER (PARTITION BY org, profile ORDER BY _version DESC) = 1)"""


def _inherit(c: str) -> str:
    return f"CASE WHEN s.{c} <> '' THEN s.{c} ELSE coalesce(p.{c}, '') END AS {c}"


def _merge(c: str) -> str:
    return (f"CASE WHEN s.{c} NOT IN ('', '{{}}') THEN CAST(json_merge_patch(CASE WHEN coalesce(p.{c}, '') NOT IN ('', '{{}}') THEN p.{c} ELSE '{{}}' END, s.{c}) AS VARCHAR) "
            f"WHEN coalesce(p.{c}, '') NOT IN ('', '{{}}') THEN p.{c} ELSE '' END AS {c}")


_RESOLVED = _LATEST + f""",
  resolved AS (SELECT s.org, s.site, s.profile, s.version, s.created, s.last_modified,
     {', '.join(_inherit(c) for c in configs.INHERITED_TEXT)}, s.folders OR coalesce(p.folders, false) AS folders,
     {', '.join(_merge(c) for c in configs.INHERITED_JSON)}
   FROM sites s LEFT JOIN profiles p ON s.org = p.org AND p.profile = CASE WHEN s.profile <> '' THEN s.profile ELSE 'default' END)"""


def _config(body: str) -> str:
    return views("site_versions profile_versions", f"WITH {_RESOLVED} {body}")


def _sites(spark, sf) -> DataFrame:
    return lookups.latest(v.site_versions(spark, sf), ["org", "site"], "_version")


def _profiles(spark, sf) -> DataFrame:
    return lookups.latest(v.profile_versions(spark, sf), ["org", "profile"], "_version")


def _resolved(spark, sf) -> DataFrame:
    return configs.resolve(_sites(spark, sf), _profiles(spark, sf))


@check("scan_latest_snapshot", """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    """A snapshot of two thirds of the versions, advanced by half of the rest and merged with the others and late repeats."""
    keys, version = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    orders = v.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    third = F.pmod(F.xxhash64("o_orderkey"), F.lit(6))
    names = [f"latest_{uuid.uuid4().hex}" for _ in range(2)]
    snapshots.write_snapshot(orders.filter(third < 4), names[0], shared_folder(spark, "snapshot"), keys, version, 8)
    snapshots.advance_snapshot(spark, names[0], orders.filter(third == 4), keys, version, names[1], shared_folder(spark, "snapshot"), 8)
    return snapshots.read_latest(spark, names[1], orders.filter((third == 5) | (third == 0)), keys, version)


@check("config_versions", views("site_versions", "SELECT * FROM site_versions QUALIFY row_number() OVER (PARTITION BY org, site ORDER BY _version DESC) = 1"))
def _(spark, sf):
    return _sites(spark, sf)


# Members of an object have no order, so merged settings compare by value.
_MEMBERS = {"features": ("a", "b.x", "b.y", "b.z", "c", "d"), "limits": ("max", "min")}


def _by_member(df: DataFrame) -> DataFrame:
    members = {f"{c}_{m.replace('.', '_')}": F.get_json_object(c, f"$.{m}") for c, names in _MEMBERS.items() for m in names}
    return df.withColumns(members).drop(*_MEMBERS)


def _by_member_sql(source: str, columns: str = "*") -> str:
    members = ", ".join(f"json_extract_string(nullif({c}, ''), '$.{m}') AS {c}_{m.replace('.', '_')}"
                        for c, names in _MEMBERS.items() for m in names)
    return f"SELECT {columns} EXCLUDE (features, limits), {members} FROM {source}"


@check("join_config_resolved", _config(_by_member_sql("resolved")))
def _(spark, sf):
    return _by_member(_resolved(spark, sf))


@check("json_merge_patch", _config(_by_member_sql("(SELECT org, site, features, limits FROM resolved)")))
def _(spark, sf):
    return _by_member(_resolved(spark, sf).select("org", "site", "features", "limits"))


_FIELDS = (*configs.INHERITED_TEXT, "folders", *configs.INHERITED_JSON)


@check("join_config_compare", _config("SELECT org, site, concat_ws(',', " + ", ".join(
    f"CASE WHEN CAST(r.{c} AS VARCHAR) <> '' AND CAST(s.{c} AS VARCHAR) <> CAST(r.{c} AS VARCHAR) THEN '{c}' END" for c in _FIELDS)
    + ") AS inherited FROM sites s JOIN resolved r USING (org, site)"))
def _(spark, sf):
    compared = configs.compare_with_resolved(_sites(spark, sf), _resolved(spark, sf))
    return compared.withColumn("inherited", F.concat_ws(",", "inherited"))


def _pct(c: str) -> str:
    return f"CAST(round(with_{c} * 100.0 / total) AS BIGINT) AS pct_{c}"


@check("config_stats", _config("SELECT *, " + ", ".join(_pct(c) for c in configs.PRESENCE) + " FROM (SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER ({cond}) AS with_{c}" for c, cond in configs.PRESENCE.items()) + " FROM sites)"))
def _(spark, sf):
    return configs.stats(_sites(spark, sf))


@check("config_by_type", _config(" UNION ALL ".join(
    f"SELECT '{k}' AS setting, CASE WHEN {c} = '' THEN '(none)' ELSE {c} END AS type, count(*) AS cnt FROM resolved GROUP BY 2"
    for k, c in configs.TYPE_COLUMNS.items())))
def _(spark, sf):
    resolved = _resolved(spark, sf)
    return reduce(DataFrame.unionByName, [configs.by_type(resolved, k).select(F.lit(k).alias("setting"), "*")
                                          for k in configs.TYPE_COLUMNS])


for _kind, _column in configs.TYPE_COLUMNS.items():
    def _by_type(spark, sf, kind=_kind):
        return configs.by_type(_sites(spark, sf), kind)

    check(f"config_by_{_kind}_type", _config(
        f"SELECT CASE WHEN {_column} = '' THEN '(none)' ELSE {_column} END AS type, count(*) AS cnt FROM sites GROUP BY 1"))(_by_type)


@check("flt_config_text", _config("""
    SELECT 'split' AS form, org, site FROM sites WHERE contains(lower(org), 'org1') AND contains(lower(site), 'site-2')
    UNION ALL SELECT 'any', org, site FROM sites WHERE contains(lower(org), 'bus4') OR contains(lower(site), 'bus4')
      OR contains(lower(cdn_prod_host), 'bus4') OR contains(lower(content_bus_id), 'bus4')"""))
def _(spark, sf):
    sites = _sites(spark, sf)
    return reduce(DataFrame.unionByName, [
        sites.filter(configs.text_matches(text)).select(F.lit(form).alias("form"), "org", "site")
        for form, text in (("split", "Org1 / Site-2"), ("any", " BUS4"))])


@check("flt_config_facets", _config("SELECT org, site FROM sites WHERE cdn_prod_type = 'fastly' AND content_source_overlay_type = ''"))
def _(spark, sf):
    return _sites(spark, sf).filter(configs.types_match({"cdn": "fastly", "overlay": "(none)", "code": ""})).select("org", "site")


@check("flt_config_chips", _config("SELECT org, site FROM sites WHERE cdn_prod_host <> '' AND folders AND profile <> ''"))
def _(spark, sf):
    return _sites(spark, sf).filter(configs.presence_matches(["cdn_host", "folders", "profile"])).select("org", "site")


_LIST = ", ".join(c for c in configs.LIST_COLUMNS if not c.endswith("_date"))


@check("config_list", _config(f"""SELECT {_LIST}, strftime(created, '%Y-%m-%d') AS created_date,
    strftime(last_modified, '%Y-%m-%d') AS last_modified_date FROM sites ORDER BY org, site LIMIT 200 OFFSET 200"""))
def _(spark, sf):
    return listing.page_of(configs.config_list(_sites(spark, sf)), 1, ["org", "site"])


@check("config_list_after", _config(f"SELECT org, site FROM sites WHERE (org, site) > ('org14', 'Site-1200') ORDER BY org, site LIMIT 200"))
def _(spark, sf):
    return listing.page_of(_sites(spark, sf), 0, ["org", "site"], after=("org14", "Site-1200")).select("org", "site")


@check("config_resolved_list", _config(_by_member_sql(f"(SELECT {', '.join(configs.RESOLVED_LIST_COLUMNS)} FROM resolved)")))
def _(spark, sf):
    return _by_member(configs.resolved_list(_resolved(spark, sf)))


_HOST = "regexp_extract({0}, '^[a-z]+://([^/:?#]+)', 1)"


@check("backfill_type", _config(f"""SELECT org, site, CASE WHEN code_source_url = '' THEN code_source_type
    WHEN {_HOST.format('code_source_url')} IN ('github.com', 'www.github.com') THEN 'github' ELSE 'byogit' END AS code_source_type FROM sites"""))
def _(spark, sf):
    return configs.backfill_code_source_type(_sites(spark, sf)).select("org", "site", "code_source_type")


@check("code_source_rule", f"""SELECT page_id, CASE WHEN {_HOST.format('url')} IN ('github.com', 'www.github.com') THEN 'github'
    WHEN {_HOST.format('url')} = '' THEN 'declared' ELSE 'byogit' END AS type FROM pages""")
def _(spark, sf):
    return v.table(spark, sf, "pages").select(
        "page_id", configs.code_source_type(F.col("url"), F.lit("declared")).alias("type"))


_RULES = config_dump.ContentRules("https://m.", ".example.org", "http://")


@check("content_type_rule", """SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'da' WHEN contains(url, '.example.org') THEN 'xwalk'
      WHEN starts_with(url, 'http://') THEN 'source' ELSE 'none' END AS type,
    CASE WHEN contains(url, 'json2html') THEN 'json2html' WHEN starts_with(url, 'https://m.') THEN 'da' WHEN contains(url, '.example.org') THEN 'xwalk'
      WHEN starts_with(url, 'http://') THEN 'source' ELSE 'none' END AS overlay FROM pages""")
def _(spark, sf):
    url, declared = F.col("url"), F.lit("none")
    return v.table(spark, sf, "pages").select(
        "page_id", config_dump.content_type(url, declared, _RULES).alias("type"),
        config_dump.overlay_type(url, declared, _RULES).alias("overlay"))


@check("evolve_add_columns", "SELECT n_nationkey, n_name, n_regionkey, '' AS code_owner, false AS folders, CAST(7 AS BIGINT) AS version FROM nation")
def _(spark, sf):
    return configs.add_missing_columns(v.table(spark, sf, "nation"), {
        "n_name": ("string", "kept"), "code_owner": ("string", ""), "folders": ("boolean", False), "version": ("bigint", 7)})


# --- lookups ----------------------------------------------------------------

_ACCESS_COLS = "request_host, request_url, request_method, response_status, cdn_script_name, cdn_time_elapsed_msec, response_headers_x_error"
_WORKER_COLS = "script_name, outcome, response_status, cpu_ms, wall_ms"


def _ray_sql(ids: str, rows: str, cols: str, extra: str = "") -> str:
    return f"""WITH f AS (SELECT ray_id, row_number() OVER (PARTITION BY ray_id ORDER BY timestamp, event_id) AS match, timestamp, {cols}{extra}
        FROM {rows} WHERE ray_id NOT IN ('', '0'))
      SELECT * FROM f WHERE match <= 5 AND ray_id IN (SELECT ray_id FROM {ids})"""


@check("join_ray_id", views("access worker", _ray_sql("worker", "access", _ACCESS_COLS)))
def _(spark, sf):
    return lookups.matches_by_request_id(v.worker(spark, sf), v.access(spark, sf), list(lookups.ACCESS_COLUMNS), tie=["event_id"])


@check("join_ray_id_worker", views("access worker", _ray_sql(
    "access", "worker", _WORKER_COLS, ", array_to_string(logs, '|') AS logs, array_to_string(exceptions, '|') AS exceptions")))
def _(spark, sf):
    found = lookups.matches_by_request_id(v.access(spark, sf), v.worker(spark, sf), list(lookups.WORKER_COLUMNS), tie=["event_id"])
    return found.withColumns({c: F.concat_ws("|", c) for c in ("logs", "exceptions")})


@check("ray_id_single", views("access", "SELECT timestamp, request_url FROM access WHERE ray_id = '321' ORDER BY timestamp, event_id LIMIT 5"))
def _(spark, sf):
    return lookups.rows_of_request_id(v.access(spark, sf), "321", ["request_url"], tie=["event_id"])


_RELEASED = """
  cur AS (SELECT * FROM releases QUALIFY row_number() OVER (PARTITION BY repo, tag ORDER BY _version DESC) = 1),
  vis AS (SELECT *, time_bucket(to_seconds(600), published, TIMESTAMP '1970-01-01') AS t FROM cur
          WHERE published BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-31')"""
_RANGE = TimeRange.free(datetime(2024, 1, 3), datetime(2024, 1, 31))


@check("releases", views("releases", f"WITH {_RELEASED} SELECT published, repo, tag, url, body FROM vis"))
def _(spark, sf):
    return lookups.releases_in(v.releases(spark, sf), _RANGE).select("published", "repo", "tag", "url", "body")


@check("join_release_overlay", views("releases access", f"""WITH {_RELEASED},
  s AS (SELECT time_bucket(to_seconds(600), timestamp, TIMESTAMP '1970-01-01') AS t, CAST(sum(CASE WHEN response_status < 400 THEN weight ELSE 0 END) AS BIGINT) AS cnt_ok
        FROM access WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-31 00:01:00' GROUP BY 1)
  SELECT repo, tag, t, coalesce(cnt_ok, 0) AS cnt_ok, repo = 'certificate-rotation' AS maintenance,
         round((epoch_us(published) - epoch_us(TIMESTAMP '2024-01-03')) / CAST(2419200000000 AS DOUBLE), 6) AS position FROM vis LEFT JOIN s USING (t)"""))
def _(spark, sf):
    series = ts.classes_over_time(v.access(spark, sf), DELIVERY, Query(_RANGE))
    placed = lookups.release_overlay(series, v.releases(spark, sf), _RANGE, v.SPECIAL_REPOS)
    return placed.select("repo", "tag", "t", "cnt_ok", "maintenance", F.round("position", 6).alias("position"))


_POINTS = "SELECT DISTINCT user_id % 5 AS grp, time_bucket(to_seconds(600), ts, TIMESTAMP '1970-01-01') AS t FROM events WHERE event_type = 'error'"


@check("join_nearest", f"""
  WITH points AS ({_POINTS}), probes AS (SELECT event_id, user_id % 5 AS grp, ts AS "at" FROM events),
  lo AS (SELECT event_id, probes.grp, "at", t FROM probes ASOF LEFT JOIN points ON probes.grp = points.grp AND probes."at" >= points.t),
  hi AS (SELECT event_id, t FROM probes ASOF LEFT JOIN points ON probes.grp = points.grp AND probes."at" <= points.t)
  SELECT event_id, grp, "at", CASE WHEN hi.t IS NULL OR "at" - lo.t <= hi.t - "at" THEN coalesce(lo.t, hi.t) ELSE hi.t END AS nearest
  FROM lo JOIN hi USING (event_id)""")
def _(spark, sf):
    events = v.events(spark, sf).withColumn("grp", F.col("user_id") % 5)
    points = events.filter("event_type = 'error'").select("grp", ts.bucket("ts", timedelta(minutes=10)).alias("t")).distinct()
    probes = events.select("event_id", "grp", F.col("ts").alias("at"))
    return lookups.nearest_points(points, probes, ["grp"], timedelta(minutes=10))


@check("ts_nearest", f"""
  WITH points AS (SELECT DISTINCT time_bucket(to_seconds(1200), ts, TIMESTAMP '1970-01-01') AS t FROM events WHERE event_type = 'view'),
  probes AS (SELECT l_orderkey, l_linenumber, TIMESTAMP '2024-01-01' + to_seconds((l_orderkey * 7 + l_linenumber) * 13 % 2592000) AS "at" FROM lineitem),
  lo AS (SELECT l_orderkey, l_linenumber, "at", t FROM probes ASOF LEFT JOIN points ON "at" >= points.t),
  hi AS (SELECT l_orderkey, l_linenumber, "at", t FROM probes ASOF LEFT JOIN points ON "at" <= points.t)
  SELECT DISTINCT l_orderkey, l_linenumber, "at", CASE WHEN lo.t IS NULL THEN hi.t WHEN hi.t IS NULL OR "at" - lo.t <= hi.t - "at" THEN lo.t ELSE hi.t END AS nearest
  FROM lo JOIN hi USING (l_orderkey, l_linenumber, "at")""")
def _(spark, sf):
    points = (v.events(spark, sf).filter("event_type = 'view'")
              .select(ts.bucket("ts", timedelta(minutes=20)).alias("t")).distinct())
    seconds = F.expr("(l_orderkey * 7 + l_linenumber) * 13 % 2592000")
    probes = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.timestamp_seconds(seconds + 1704067200).cast("timestamp_ntz").alias("at")).distinct()
    return lookups.nearest_points(points, probes, [], timedelta(minutes=20))


# --- class columns ----------------------------------------------------------

def _classes(name: str, view: str, column: str, case: str, classifier: str):
    @check(f"class_{name}", views(view, f"SELECT {case} AS class, count(*) AS n FROM {view} GROUP BY 1"))
    def _(spark, sf):
        load = {"access": v.access, "worker": v.worker, "app_log": v.app_log_in}[view]
        return load(spark, sf).groupBy(classify.CLASSIFIERS[classifier](F.col(column)).alias("class")).agg(
            F.count(F.lit(1)).alias("n"))


def _case(column: str, rules: list[tuple[str, str]], default: str = "") -> str:
    return f"CASE WHEN {column} = '' THEN '' " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in rules) + f" ELSE '{default}' END"


_classes("status", "access", "response_status", "CASE WHEN response_status < 400 THEN 'ok' WHEN response_status < 500 THEN 'client-error' ELSE 'server-error' END", "status")
_classes("host", "access", "request_headers_x_forwarded_host", _case("request_headers_x_forwarded_host", [
    ("lower(trim(split_part(request_headers_x_forwarded_host, ',', 1))) LIKE '%.live'", "delivery"),
    ("lower(trim(split_part(request_headers_x_forwarded_host, ',', 1))) LIKE '%.page'", "authoring")], "customer"), "host")
_classes("content_type", "access", "response_headers_content_type", _case("response_headers_content_type", [
    ("response_headers_content_type LIKE 'text/%'", "text"), ("response_headers_content_type LIKE 'application/%'", "application"),
    ("response_headers_content_type LIKE 'image/%'", "image")]), "content_type")
_classes("cache_status", "access", "cdn_cache_status", _case("upper(cdn_cache_status)", [
    ("upper(cdn_cache_status) LIKE 'HIT%'", "hit"), ("upper(cdn_cache_status) LIKE 'MISS%'", "miss"), ("cdn_cache_status = 'PASS'", "pass")]), "cache_status")
_classes("request_type", "access", "platform_request_type", "platform_request_type", "request_type")
_classes("backend_type", "access", "platform_backend_type", "CASE platform_backend_type WHEN 'aws' THEN 'fastly-aws' WHEN 'cloudflare' THEN 'cf-workers' ELSE '' END", "backend_type")
_classes("method", "access", "request_method", "lower(request_method)", "method")
_classes("network", "access", "client_name", _case("client_name", [], "other"), "network")
_classes("error", "access", "response_headers_x_error", _case("response_headers_x_error", [("contains(response_headers_x_error, 'failed to load')", "content")], "other"), "error")
_classes("ip", "access", "cdn_originating_ip", "CASE WHEN contains(cdn_originating_ip, ':') THEN 'v6' ELSE 'v4' END", "ip")
_classes("user_agent", "access", "request_headers_user_agent", _case("request_headers_user_agent", [
    ("contains(request_headers_user_agent, '+http')", "good-bot"), ("request_headers_user_agent NOT LIKE 'Mozilla%'", "bad-bot"),
    ("contains(request_headers_user_agent, 'iPhone')", "ios"), ("contains(request_headers_user_agent, 'Windows')", "windows")]), "user_agent")
_classes("referer", "access", "request_headers_referer", _case("request_headers_referer", [
    ("contains(request_headers_referer, 'google.com')", "google"), ("contains(request_headers_referer, '.live')", "platform")], "other"), "referer")
_classes("path", "access", "request_url", "CASE WHEN request_url LIKE '%.html' THEN 'document' WHEN request_url LIKE '%.js' THEN 'script' ELSE 'clean' END", "path")
_classes("accept", "access", "request_headers_accept", "CASE WHEN request_headers_accept LIKE 'text/%' THEN 'text' WHEN request_headers_accept LIKE 'image/%' THEN 'image' ELSE 'binary' END", "accept")
_classes("encoding", "access", "request_headers_accept_encoding", "CASE WHEN request_headers_accept_encoding LIKE '%br%' THEN 'br' ELSE request_headers_accept_encoding END", "encoding")
_classes("cache_control", "access", "request_headers_cache_control", "CASE request_headers_cache_control WHEN '' THEN '' WHEN 'no-store' THEN 'no-store' ELSE 'no-cache' END", "cache_control")
_classes("customer_cdn", "access", "request_headers_x_byo_cdn_type", "request_headers_x_byo_cdn_type", "customer_cdn")
_classes("location", "access", "response_headers_location", _case("response_headers_location", [("response_headers_location LIKE 'http%'", "absolute")], "relative"), "location")
_classes("level", "app_log", "level", "CASE upper(level) WHEN 'ERROR' THEN 'server-error' WHEN 'WARN' THEN 'client-error' WHEN 'WARNING' THEN 'client-error' ELSE 'ok' END", "level")
_classes("outcome", "worker", "outcome", "CASE outcome WHEN 'exception' THEN 'server-error' WHEN 'exceeded' THEN 'server-error' WHEN 'canceled' THEN 'client-error' ELSE 'ok' END", "outcome")


_URL_PATH = "regexp_replace(split_part(url, '#', 1), '^[a-z]+://[^/]*', '')"


@check("class_page_path", f"""
  WITH p AS (SELECT page_id, lower(split_part({_URL_PATH}, '?', 1)) AS path FROM pages),
  l AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS seg FROM p)
  SELECT page_id, CASE WHEN path = '' THEN '' WHEN path LIKE '%/' THEN 'directory' WHEN NOT contains(substr(seg, 2), '.') THEN 'clean'
    WHEN regexp_extract(seg, '[^.]*$') IN ('html', 'htm', 'pdf', 'txt', 'xml') THEN 'document'
    WHEN regexp_extract(seg, '[^.]*$') IN ('js', 'mjs', 'json', 'css', 'map') THEN 'script' ELSE '' END AS class FROM l""")
def _(spark, sf):
    path = F.regexp_replace(F.split_part("url", F.lit("#"), F.lit(1)), "^[a-z]+://[^/]*", "")
    return v.table(spark, sf, "pages").select("page_id", classify.path_class(path).alias("class"))


@check("append_flagged", views("access", f"""
  WITH c AS (SELECT request_url AS dim, CAST(sum(weight) AS BIGINT) AS cnt FROM access WHERE {MONTH_WHERE} GROUP BY 1),
  top AS (SELECT * FROM c ORDER BY cnt DESC, dim LIMIT 5)
  SELECT dim, cnt, false AS is_filtered FROM top UNION ALL
  SELECT dim, cnt, true FROM c WHERE dim IN ('/view/7.js', '/view/8') AND dim NOT IN (SELECT dim FROM top)"""))
def _(spark, sf):
    from tidegauge.operators import breakdown as bd
    df, facet = v.access(spark, sf), DELIVERY.facets["paths"]
    shown = bd.breakdown(df, DELIVERY, facet, MONTH)
    flagged = bd.add_selected(shown, bd.facet_groups(df, DELIVERY, facet, MONTH), ["/view/7.js", "/view/8"])
    return flagged.filter(F.col("kind") != bd.TOTAL).select("dim", "cnt", (F.col("kind") == bd.SELECTED).alias("is_filtered"))
