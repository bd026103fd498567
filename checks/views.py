"""Log-shaped views of the given tables, computed alike by Spark and DuckDB.

Every view derives each of its rows from one row of a given table, so work
grows with the tables. Expressions are written in the SQL both engines share;
the few that differ are pairs (Spark, DuckDB).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.spec import TimeRange

AS_OF = datetime(2024, 1, 31)
MONTH = TimeRange.free(datetime(2024, 1, 1), datetime(2024, 1, 31))
LIVE_SUFFIX = ".example.live"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def pick(number: str, *values: str) -> str:
    """The value at position ``number`` modulo the number of values."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


IP = f"CASE WHEN user_id % 3 = 0 THEN '2001:db8::' || {s('user_id')} ELSE '10.0.' || {s('user_id % 256')} || '.' || {s('k')} END"
STATUS = ("CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 503 ELSE 404 END "
          "WHEN event_type = 'signup' THEN 301 ELSE 200 END AS INT)")

ACCESS: dict[str, str] = {
    "event_id": "event_id",
    "k": "k",
    "timestamp": "ts",
    "weight": "CAST(1 + k % 10 AS BIGINT)",
    "source": "CASE WHEN event_id % 3 = 0 THEN 'cloudflare' ELSE 'fastly' END",
    "response_status": STATUS,
    "request_method": "CASE WHEN event_type IN ('click', 'view') THEN 'GET' WHEN event_type = 'error' THEN 'PUT' ELSE 'POST' END",
    "request_host": f"'main--site' || {s('user_id % 20')} || '--org' || {s('user_id % 5')} || CASE WHEN k % 9 = 0 THEN '.example.page' ELSE '.example.live' END",
    "request_headers_x_forwarded_host": (
        f"CASE WHEN k % 4 = 0 THEN '' WHEN k % 17 = 0 THEN '10.0.0.1' WHEN k % 19 = 0 THEN 'localhost:80' "
        f"ELSE 'WWW.Shop' || {s('user_id % 7')} || '.example.com:443, edge.example.net' END"),
    "request_url": f"'/' || event_type || '/' || {s('k')} || {pick('k', chr(39) + '.html' + chr(39), chr(39) + '.js' + chr(39), chr(39) + chr(39))}",
    "request_protocol": "'HTTP/2'",
    "request_qs": f"CASE WHEN k % 5 = 0 THEN 'q=' || {s('k')} ELSE '' END",
    "request_backend": f"'origin' || {s('k % 3')}",
    "request_body_size": "CAST(k * 3 AS BIGINT)",
    "request_is_mixed_case": "k % 2 = 1",
    "request_restarts": "CAST(k % 3 AS BIGINT)",
    "request_headers_user_agent": pick("user_id", "'Mozilla/5.0 (Windows NT 10.0)'", "'Mozilla/5.0 (compatible; Bot; +http://bot.example)'", "'curl/8.0'", "'Mozilla/5.0 (iPhone)'"),
    "request_headers_referer": pick("k", "''", "'https://www.google.com/'", "'https://shop.example.com/a'", "'https://main.example.live/'"),
    "request_headers_accept": pick("k", "'text/html'", "'*/*'", "'image/webp'"),
    "request_headers_accept_encoding": pick("k", "'gzip, br'", "'gzip'", "''", "'identity'"),
    "request_headers_accept_language": pick("k", "'en'", "'de'", "''"),
    "request_headers_cache_control": pick("k", "''", "'no-cache'", "'max-age=0'", "'no-store'"),
    "request_headers_cdn_loop": pick("k", "''", "'loop'"),
    "request_headers_via": pick("k", "''", "'1.1 edge'"),
    "request_headers_x_forwarded_for": IP,
    "request_headers_x_byo_cdn_type": pick("k", "''", "'fastly'", "'akamai'", "'cloudfront'", "'other'"),
    "request_headers_x_push_invalidation": pick("k", "''", "'enabled'"),
    "response_body_size": "CAST(k * 7 AS BIGINT)",
    "response_headers_content_type": pick("k", "'text/html; charset=utf-8'", "'application/json'", "'image/png'", "''"),
    "response_headers_content_encoding": pick("k", "'gzip'", "''", "'br'"),
    "response_headers_content_length": "CASE WHEN k % 10 = 0 THEN 0 ELSE CAST(floor(value * value) AS BIGINT) END",
    "response_headers_cache_control": pick("k", "''", "'max-age=7200'"),
    "response_headers_vary": pick("k", "''", "'Accept'"),
    "response_headers_location": "CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN '/welcome' ELSE 'https://www.example.com/welcome' END ELSE '' END",
    "response_headers_x_error": f"CASE WHEN event_type = 'error' THEN 'failed to load /p' || {s('user_id')} || '/x.json' ELSE '' END",
    "response_headers_x_surrogate_key": f"CASE WHEN k % 4 = 0 THEN '' ELSE 'key' || {s('k')} END",
    "response_headers_edge_cache_tag": pick("k", "''", "'tag'"),
    "response_headers_edge_control": pick("k", "''", "'ec'"),
    "response_headers_x_severity": "CASE WHEN event_type = 'error' THEN 'error' WHEN k % 5 = 0 THEN 'warn' ELSE '' END",
    "response_headers_x_ratelimit_limit": "CASE WHEN k % 6 = 0 THEN '100' WHEN k % 6 = 1 THEN '250' ELSE '' END",
    "response_headers_x_ratelimit_rate": f"CASE WHEN k % 6 = 0 THEN {s('k * 13')} WHEN k % 6 = 1 THEN 'n/a' ELSE '' END",
    "response_headers_x_rate_limited_rate": f"CASE WHEN k % 5 = 0 THEN {s('k * 2')} || '.5' WHEN k % 5 = 1 THEN '1d' ELSE '' END",
    "cdn_cache_status": pick("k", "'HIT'", "'miss'", "'PASS'", "'Hit-stale'", "''"),
    "cdn_cache_ttl": "CAST(k AS DOUBLE)",
    "cdn_datacenter": f"'DC' || {s('user_id % 12')}",
    "cdn_region_code": f"'R' || {s('user_id % 3')}",
    "cdn_originating_ip": IP,
    "cdn_url": f"'https://shop.example.com/' || event_type || '/' || {s('k')}",
    "cdn_version": f"CASE WHEN k % 11 = 0 THEN '' ELSE 'v' || {s('k % 4')} END",
    "cdn_is_edge": "k % 3 <> 0",
    "cdn_time_elapsed_msec": "value * 10",
    "cdn_script_name": f"CASE WHEN k % 2 = 0 THEN '' ELSE 'script' || {s('k % 4')} END",
    "client_ip": IP,
    "client_name": f"CASE WHEN user_id % 6 = 0 THEN '' ELSE 'net ' || {s('user_id % 30')} END",
    "client_asn": "CAST(user_id % 30 AS BIGINT)",
    "client_city_name": f"'city' || {s('user_id % 9')}",
    "client_country_name": f"'country' || {s('user_id % 4')}",
    "platform_backend_type": pick("k", "'aws'", "'cloudflare'", "'other'"),
    "platform_request_type": pick("k", "'pipeline'", "'static'", "'media'", "''"),
    "platform_contentbus_prefix": pick("k", "'live'", "'preview'", "''"),
    "platform_route": pick("k", "'code'", "'preview'", "''"),
    "platform_topic": pick("k", "'log'", "''"),
    "platform_scope": pick("k", "'delivery'", "'raw'"),
    "platform_contentbus_id": f"'bus' || {s('k % 8')}",
    "platform_org": f"'org' || {s('user_id % 5')}",
    "platform_site": f"'site' || {s('user_id % 20')}",
    "platform_repo": f"CASE WHEN k % 7 = 0 THEN '' ELSE 'Site' || {s('user_id % 20')} END",
    "platform_owner": f"CASE WHEN k % 8 = 0 THEN '' ELSE 'org' || {s('user_id % 5')} END",
    "platform_path": f"'/' || event_type || '/' || {s('k % 10')}",
    "platform_ref": pick("k", "'main'", "'dev'", "''"),
    "platform_rso": f"CASE WHEN k % 5 = 0 THEN '' ELSE 'main--site' || {s('user_id % 20')} END",
    "subsystem": pick("k", "''", "'render'", "'index'"),
    "ray_id": f"CASE WHEN k % 13 = 0 THEN '0' WHEN k % 29 = 0 THEN '' ELSE {s('event_id % 997')} END",
}

# Worker invocations: the same requests seen from inside the worker.
WORKER: dict[str, str | tuple[str, str]] = {
    "event_id": "event_id",
    "timestamp": "ts",
    "script_name": f"'worker' || {s('user_id % 4')}",
    "outcome": "CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'exception' WHEN event_type = 'error' AND k % 7 = 0 THEN 'exceeded' WHEN k % 11 = 0 THEN 'canceled' ELSE 'ok' END",
    "response_status": f"CASE WHEN k % 5 = 0 THEN 0 ELSE {STATUS} END",
    "request_method": "CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END",
    "request_url": f"'https://w.example.net/' || event_type || '/' || {s('k')}",
    "ray_id": f"CASE WHEN k % 13 = 0 THEN '0' WHEN k % 29 = 0 THEN '' ELSE {s('event_id % 1009')} END",
    "logs": (f"CASE WHEN k % 5 = 0 THEN CAST(array() AS array<string>) ELSE array('log ' || {s('k % 6')}, 'log ' || {s('user_id % 3')}) END",
             f"CASE WHEN k % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['log ' || {s('k % 6')}, 'log ' || {s('user_id % 3')}] END"),
    "exceptions": ("CASE WHEN event_type = 'error' AND k % 3 = 0 THEN array('boom') ELSE CAST(array() AS array<string>) END",
                   "CASE WHEN event_type = 'error' AND k % 3 = 0 THEN ['boom'] ELSE CAST([] AS VARCHAR[]) END"),
    "cpu_ms": "CAST(k AS DOUBLE)",
    "wall_ms": "value",
    "script_version": f"'v' || {s('user_id % 10')}",
}

# Application log lines: documents as messages, every fourth one as JSON.
APP_LOG: dict[str, str | tuple[str, str]] = {
    "doc_id": "doc_id",
    "timestamp": ("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (doc_id % 10007) * 251)",
                  "TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id % 10007) * 251)"),
    "level": "CASE lang WHEN 'en' THEN 'info' WHEN 'fr' THEN 'ERROR' WHEN 'de' THEN 'warn' ELSE 'Warning' END",
    "message": f"CASE WHEN doc_id % 4 = 0 THEN '{{\"admin\":{{\"method\":\"' || CASE WHEN doc_id % 8 = 0 THEN 'GET' ELSE 'POST' END || '\",\"duration\":' || {s('n_chars')} || '}}}}' ELSE text END",
    "request_id": f"'req-' || {s('doc_id % 50')}",
    "function_name": f"'svc/' || source || '/v' || {s('doc_id % 3')}",
    "app_name": f"'app' || {s('doc_id % 4')}",
    "subsystem": "source",
    "log_stream": f"'stream' || {s('doc_id % 7')}",
    "log_group": f"'/group/' || {s('doc_id % 6')}",
}


def _side(expr: str | tuple[str, str], side: int) -> str:
    return expr if isinstance(expr, str) else expr[side]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _view(df: DataFrame, columns: dict) -> DataFrame:
    return df.selectExpr(*[f"{_side(e, 0)} AS `{n}`" for n, e in columns.items()])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def access(spark: SparkSession, sf: str) -> DataFrame:
    return _view(events(spark, sf), ACCESS)


def worker(spark: SparkSession, sf: str) -> DataFrame:
    return _view(events(spark, sf), WORKER)


def app_log_in(spark: SparkSession, sf: str) -> DataFrame:
    return _view(table(spark, sf, "documents"), APP_LOG)


def _cte(columns: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{_side(e, 1)} AS {n}" for n, e in columns.items()) + f" FROM {source}"


_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"

# Versioned site and profile settings, one to three versions each.
FEATURES = (f"CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '{{}}' WHEN 2 THEN '{{\"a\":' || {s('c_custkey % 10')} || ',\"b\":{{\"x\":1}}}}' "
            f"ELSE '{{\"b\":{{\"x\":null,\"y\":' || {s('c_custkey % 6')} || '}},\"c\":[1]}}' END")
LIMITS = f"CASE c_custkey % 3 WHEN 0 THEN '{{}}' ELSE '{{\"max\":' || {s('c_custkey % 9')} || '}}' END"
SITE_COLUMNS = {
    "org": f"'org' || {s('c_nationkey')}",
    "site": f"'Site-' || {s('c_custkey')}",
    "version": "CAST(_version * 10 AS BIGINT)",
    "created": ("timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 365 AS INT))",
                "TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INT))"),
    "last_modified": ("timestamp_ntz'2023-06-01 00:00:00' + make_dt_interval(CAST(c_custkey % 100 AS INT))",
                      "TIMESTAMP '2023-06-01 00:00:00' + to_days(CAST(c_custkey % 100 AS INT))"),
    "code_owner": f"CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'owner' || {s('c_custkey % 11')} END",
    "code_repo": f"CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'repo' || {s('c_custkey % 13')} END",
    "code_source_type": "CASE WHEN c_custkey % 6 = 0 THEN 'github' ELSE '' END",
    "code_source_url": f"CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://github.com/o/r' || {s('c_custkey')} WHEN 2 THEN 'https://git.example.org/r' ELSE 'https://www.github.com/x' END",
    "content_bus_id": f"CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Bus' || {s('c_custkey % 50')} END",
    "content_source_type": "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'onedrive' WHEN 2 THEN 'google' ELSE 'markup' END",
    "content_source_url": f"CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'https://content.example.com/' || {s('c_custkey % 17')} END",
    "content_source_overlay_type": "CASE WHEN c_custkey % 10 = 0 THEN 'json2html' ELSE '' END",
    "content_source_overlay_url": f"CASE WHEN c_custkey % 10 = 0 THEN 'https://overlay.example.com/' || {s('_version')} ELSE '' END",
    "cdn_prod_host": f"CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'www.shop' || {s('c_custkey')} || '-v' || {s('_version')} || '.example.com' END",
    "cdn_prod_type": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'fastly' WHEN 2 THEN 'akamai' WHEN 3 THEN 'cloudflare' ELSE 'managed' END",
    "profile": f"CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'p' || {s('c_custkey % 4')} END",
    "folders": "c_custkey % 6 = 1",
    "features": FEATURES,
    "limits": LIMITS,
    "_version": "_version",
}
PROFILE_COLUMNS = {
    "org": f"'org' || {s('n_nationkey')}",
    "profile": f"CASE WHEN n_nationkey % 2 = 0 THEN 'default' ELSE 'p' || {s('n_nationkey % 4')} END",
    "version": "_version",
    **{c: f"'inherited-{c}'" for c in (
        "cdn_prod_host", "cdn_prod_type", "code_owner", "code_repo", "code_source_type", "code_source_url",
        "content_bus_id", "content_source_type", "content_source_url")},
    "content_source_overlay_type": "''",
    "content_source_overlay_url": f"CASE WHEN _version = 2 THEN 'https://profile.example.com/' || {s('n_nationkey')} ELSE '' END",
    "folders": "n_nationkey % 3 = 0",
    "features": "CASE WHEN n_nationkey % 3 = 0 THEN '{}' ELSE '{\"b\":{\"x\":2,\"z\":\"ü\"},\"d\":true}' END",
    "limits": "CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '{\"max\":5,\"min\":1}' END",
    "_version": "_version",
}


def _versioned(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_version", F.explode(F.expr(f"sequence(1L, 1L + {key} % 3)")))


def site_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Wide versions of narrow customers, which are spread first: one scan task may hold the whole table."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    return _view(_versioned(table(spark, sf, "customer").repartition(tasks, "c_custkey"), "c_custkey"), SITE_COLUMNS)


def profile_versions(spark: SparkSession, sf: str) -> DataFrame:
    return _view(_versioned(table(spark, sf, "nation"), "n_nationkey"), PROFILE_COLUMNS)


# Releases: signups; a repo and tag are published again as newer versions.
RELEASE: dict[str, str] = {
    "published": "ts",
    "repo": "CASE WHEN user_id % 10 = 0 THEN 'certificate-rotation' ELSE 'service-' || CAST(user_id % 10 AS STRING) END",
    "tag": f"'v' || {s('user_id')}",
    "url": f"'https://releases.example.com/' || {s('event_id')}",
    "body": "event_type",
    "_version": "event_id",
}
SPECIAL_REPOS = ("certificate-rotation",)


def releases(spark: SparkSession, sf: str) -> DataFrame:
    return _view(events(spark, sf).filter("event_type = 'signup'"), RELEASE)


CTES = {
    "access": _cte(ACCESS, _EVENTS),
    "worker": _cte(WORKER, _EVENTS),
    "app_log": _cte(APP_LOG, "documents"),
    "site_versions": _cte(SITE_COLUMNS, "(SELECT *, unnest(generate_series(1, 1 + c_custkey % 3)) AS _version FROM customer)"),
    "profile_versions": _cte(PROFILE_COLUMNS, "(SELECT *, unnest(generate_series(1, CAST(1 + n_nationkey % 3 AS BIGINT))) AS _version FROM nation)"),
    "releases": _cte(RELEASE, f"{_EVENTS} WHERE event_type = 'signup'"),
}


def with_views(names: str, query: str) -> str:
    """Prefix a query (which may itself continue the WITH list) with views."""
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in names.split())
    query = query.strip()
    joiner = ", " if query.upper().startswith("WITH ") else " "
    body = query[5:] if joiner == ", " else query
    return f"WITH {ctes}{joiner}{body}"
