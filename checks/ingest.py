"""Sources, normalisation, sampling, routing, sinks and streaming jobs."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views as v
from checks.registry import check
from checks.sqltext import breakdown as sql_breakdown, counters
from checks.traffic import DUCK_DIMS, DUCK_STATUS_RANGE
from tidegauge.functions.entities import ENTITY_PATTERNS, with_entities
from tidegauge.operators import breakdown as bd
from tidegauge.operators import lookups
from tidegauge.operators.aggregates import traffic_counters
from tidegauge.plans.dashboards import DELIVERY
from tidegauge.session import shared_folder
from tidegauge.sources import config_dump, normalize, readers, rollup, writers
from tidegauge.sources.schemas import APP_LOG_IN, FLAT_HEADERS, NORMALISED, SERVICES, TAIL, staging_schema
from tidegauge.spec import Query, TimeRange
from tidegauge.streaming import jobs
from tidegauge.streaming.live import LiveTable

MONTH = Query(v.MONTH, top=10)


def views(names: str, sql: str) -> str:
    return v.with_views(names, sql)


def millis(column: Column) -> Column:
    return F.unix_millis(column.cast("timestamp"))


def plain_times(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema
                           if f.dataType.typeName() == "timestamp"})


# --- raw sources ------------------------------------------------------------

@check("src_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(spark, sf):
    path = shared_folder(spark, "jsonl")
    v.table(spark, sf, "events").drop("ts").write.option("compression", "gzip").json(path)
    return readers.read_json_lines(spark, path, "event_id bigint, user_id bigint, event_type string, value double, props string")


@check("src_lambda", views("app_log", "SELECT level, message, request_id, function_name, app_name, subsystem, log_stream, log_group, timestamp FROM app_log"))
def _(spark, sf):
    path = shared_folder(spark, "app-log")
    v.app_log_in(spark, sf).drop("doc_id").write.option("compression", "gzip").json(path)
    return plain_times(readers.read_json_lines(spark, path, APP_LOG_IN))


@check("src_tail", views("worker", "SELECT script_name, outcome, 'fetch' AS event_type, date_trunc('milliseconds', timestamp) AS timestamp, request_url AS data FROM worker"))
def _(spark, sf):
    path = shared_folder(spark, "tail")
    v.worker(spark, sf).select("script_name", millis(F.col("timestamp")).alias("event_timestamp"), "outcome",
                               F.lit("fetch").alias("event_type"), F.col("request_url").alias("data")).write.json(path)
    rows = normalize.normalise_tail(readers.read_json_lines(spark, path, TAIL))
    return plain_times(rows.drop("event_timestamp"))


# --- nested service records -------------------------------------------------

HTTP_DATE = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"
RENAMED = {
    "client_number": "client_asn",
    "response_headers_surrogate_key": "response_headers_x_surrogate_key",
    "response_headers_surrogate_control": "response_headers_edge_control",
}


def _nested(schema: T.StructType, columns: list[str], path: str = "") -> Column:
    """A staging record whose fields hold the access view's columns."""
    fields = []
    for field in schema:
        name = f"{path}_{field.name}" if path else field.name
        if isinstance(field.dataType, T.StructType):
            value = _nested(field.dataType, columns, name)
        elif name == "response_headers_last_modified":
            stamp = F.date_trunc("second", F.col("timestamp").cast("timestamp"))
            value = F.date_format(stamp, HTTP_DATE) if field.dataType.typeName() == "string" else stamp
        elif name == "time_elapsed":
            value = F.col("k").cast("bigint") * 1000
        else:
            source = RENAMED.get(name, name)
            source = source if source in columns else f"cdn_{name}"
            value = F.col(source) if source in columns else F.lit(None)
        fields.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def raw_service(spark, sf, service: str) -> DataFrame:
    access = v.access(spark, sf)
    schema = T.StructType.fromDDL(staging_schema(service))
    name = "text" if service == "form" else "json"
    record = schema[name].dataType
    # Form records nest everything below "cdn".
    value = (F.struct(_nested(record["cdn"].dataType, access.columns).alias("cdn")) if service == "form"
             else _nested(record, access.columns))
    return access.select(millis(F.col("timestamp")).alias("timestamp"), value.alias(name))


_NO_HEADERS = "request_headers_x_byo_cdn_type request_headers_x_push_invalidation"
_CACHE = "cdn_cache_status cdn_cache_ttl cdn_is_edge"
_ADMIN = (f"{_CACHE} request_backend request_qs request_is_mixed_case request_restarts request_headers_cdn_loop {_NO_HEADERS} "
          "response_headers_cache_control response_headers_vary response_headers_x_surrogate_key response_headers_edge_cache_tag "
          "response_headers_edge_control")
# Per service, the columns its records cannot fill.
ABSENT = {
    "generic": "",
    "www": f"platform_contentbus_prefix platform_request_type request_is_mixed_case request_headers_cdn_loop {_NO_HEADERS} "
           "response_headers_edge_cache_tag response_headers_edge_control",
    "admin": _ADMIN,
    "api": _ADMIN,
    "config": "request_is_mixed_case response_headers_edge_cache_tag",
    "media": f"request_body_size request_is_mixed_case request_headers_accept_language request_headers_referer request_headers_user_agent "
             f"request_headers_via {_NO_HEADERS} response_headers_vary response_headers_edge_cache_tag",
    "pipeline": f"{_CACHE} client_city_name client_country_name client_ip client_name client_asn request_backend request_body_size "
                f"request_is_mixed_case request_headers_accept_language request_headers_cache_control request_headers_cdn_loop "
                f"request_headers_referer request_headers_user_agent request_headers_via request_headers_x_forwarded_for {_NO_HEADERS} "
                "response_headers_edge_cache_tag",
    "static": f"{_CACHE} cdn_originating_ip cdn_url request_body_size request_qs request_is_mixed_case request_headers_accept_language "
              f"request_headers_cache_control request_headers_referer request_headers_user_agent request_headers_x_forwarded_for {_NO_HEADERS} "
              "response_headers_cache_control response_headers_edge_cache_tag response_headers_edge_control",
    "form": f"{_CACHE} platform_contentbus_prefix request_qs request_is_mixed_case request_restarts request_headers_accept_encoding "
            f"request_headers_accept_language request_headers_cache_control request_headers_cdn_loop request_headers_via {_NO_HEADERS} "
            "response_headers_cache_control response_headers_content_type response_headers_content_encoding response_headers_vary "
            "response_headers_location response_headers_x_surrogate_key response_headers_edge_cache_tag response_headers_edge_control",
}
# Display names of the services.
LABELS = {"www": "WWW", "admin": "Admin", "api": "API", "config": "Config", "media": "Image Optimizer",
          "pipeline": "Pipeline", "static": "Static", "form": "Forms"}
OVERRIDES = {
    "generic": {
        "platform_backend_type": "CASE WHEN platform_request_type = 'media' THEN 'Fastly / Image Optimizer' WHEN request_host LIKE 'main--site1.%' THEN 'x' "
                                 "WHEN platform_backend_type = 'aws' THEN 'Fastly / AWS' WHEN platform_backend_type = 'cloudflare' THEN 'Fastly / Cloudflare' ELSE 'Fastly / Other' END"},
    "admin": {"platform_contentbus_prefix": "platform_ref || '--' || platform_repo || '--' || platform_owner", "platform_request_type": "platform_route"},
    "api": {"platform_contentbus_prefix": "platform_org || '--' || platform_site", "platform_request_type": "platform_topic"},
    "config": {"platform_contentbus_prefix": "platform_rso", "platform_request_type": "platform_scope"},
    "media": {"platform_contentbus_prefix": "platform_contentbus_id", "platform_request_type": "'media'"},
    "form": {"platform_request_type": "'form'", "cdn_time_elapsed_msec": "CAST(k AS DOUBLE)",
             "response_headers_last_modified": "TIMESTAMP '1970-01-01'"},
}
DEFAULTS = {"string": "''", "bigint": "CAST(0 AS BIGINT)", "double": "CAST(0 AS DOUBLE)", "boolean": "false", "int": "0"}
SERVICE_COLUMNS = [n for n in NORMALISED if n in v.ACCESS or n in ("response_headers_last_modified",)]


def _service_sql(service: str) -> str:
    absent, special = ABSENT[service].split(), OVERRIDES.get(service, {})
    parts = []
    for name in SERVICE_COLUMNS:
        if name == "request_headers_accept" or name not in NORMALISED:
            continue
        kind = NORMALISED[name][0]
        if name in special:
            expr = special[name]
        elif name in absent:
            expr = DEFAULTS[kind]
        elif name == "timestamp":
            expr = "date_trunc('milliseconds', timestamp)"
        elif name == "source":
            expr = "'fastly'"
        elif name == "platform_backend_type":
            expr = f"'Fastly / {LABELS[service]}'"
        elif name == "response_headers_last_modified":
            expr = "date_trunc('second', timestamp)"
        elif name == "response_headers_content_length" and service not in ("generic", "media"):
            expr = "response_body_size"
        else:
            expr = name
        parts.append(f"{expr} AS {name}")
    return "SELECT " + ", ".join(parts) + " FROM access"


def _norm_check(service: str) -> None:
    @check(f"norm_{service}", views("access", _service_sql(service)))
    def _(spark, sf):
        return plain_times(normalize.normalise_service(raw_service(spark, sf, service), service))


for _service in SERVICES:
    _norm_check(_service)


@check("src_nested", views("access", """SELECT request_host AS host, platform_request_type AS kind, request_headers_referer AS referer,
    CAST(response_status AS VARCHAR) AS status, request_restarts AS restarts FROM access"""))
def _(spark, sf):
    path = shared_folder(spark, "nested")
    raw_service(spark, sf, "generic").write.json(path)
    rows = readers.read_json_lines(spark, path, staging_schema("generic"))
    return rows.select("json.request.host", F.col("json.platform.request_type").alias("kind"),
                       "json.request.headers.referer", "json.response.status", "json.request.restarts")


# --- flat records -----------------------------------------------------------

_FLAT_SENT = ("accept", "accept_encoding", "accept_language", "cache_control", "cdn_loop", "via", "x_byo_cdn_type", "x_forwarded_for",
              "x_forwarded_host", "x_push_invalidation")
_FLAT_GOT = ("cache_control", "content_encoding", "edge_cache_tag", "edge_control", "vary", "location", "x_error", "x_surrogate_key")


def raw_flat(spark, sf) -> DataFrame:
    access = v.access(spark, sf)

    def headers(group: str, names) -> list[Column]:
        return [F.nullif(F.col(f"{group}_headers_{n}"), F.lit("")).alias(n.replace("_", "-")) for n in names]

    modified = F.when(F.col("k") % 5 != 0, F.date_format(F.date_trunc("second", F.col("timestamp").cast("timestamp")), HTTP_DATE)).otherwise("not a date")
    flat = access.select(
        (F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000).alias("EdgeStartTimestamp"),
        F.col("client_ip").alias("ClientIP"), F.col("client_asn").alias("ClientASN"),
        F.col("client_country_name").alias("ClientCountry"), F.col("cdn_region_code").alias("ClientRegionCode"),
        F.col("request_host").alias("ClientRequestHost"), F.col("request_method").alias("ClientRequestMethod"),
        F.col("request_url").alias("ClientRequestURI"), F.col("request_protocol").alias("ClientRequestProtocol"),
        F.col("request_headers_referer").alias("ClientRequestReferer"), F.col("request_headers_user_agent").alias("ClientRequestUserAgent"),
        F.col("cdn_cache_status").alias("CacheCacheStatus"), F.col("cdn_datacenter").alias("EdgeColoCode"),
        F.col("response_status").alias("EdgeResponseStatus"), F.col("response_headers_content_type").alias("EdgeResponseContentType"),
        F.col("response_body_size").alias("EdgeResponseBytes"), F.col("k").cast("bigint").alias("EdgeTimeToFirstByteMs"),
        F.when(F.col("platform_topic") == "log", "edgeWorkerCacheAPI").otherwise("eyeball").alias("ClientRequestSource"),
        F.to_json(F.struct(*headers("request", _FLAT_SENT))).alias("RequestHeaders"),
        F.to_json(F.struct(*headers("response", _FLAT_GOT), F.col("response_headers_content_length").cast("string").alias("content-length"),
                           modified.alias("last-modified"))).alias("ResponseHeaders"))
    return flat


_OWN_HOST = "main--site4--org4.example.live"


def _flat_sql() -> str:
    special = {
        "timestamp": "date_trunc('milliseconds', timestamp)", "source": "'cloudflare'", "cdn_is_edge": "true",
        "cdn_time_elapsed_msec": "CAST(k AS DOUBLE)", "cdn_url": "'https://' || request_host || request_url",
        "platform_backend_type": "CASE WHEN request_host LIKE '%.example.page' THEN 'Cloudflare / Own' ELSE 'Cloudflare / Workers' END",
        "response_headers_last_modified": "CASE WHEN k % 5 <> 0 THEN date_trunc('second', timestamp) ELSE TIMESTAMP '1970-01-01' END",
    }
    kept = {"cdn_cache_status", "cdn_datacenter", "cdn_originating_ip", "cdn_region_code", "client_country_name", "client_ip", "client_asn",
            "request_host", "request_method", "request_protocol", "request_url", "request_headers_referer", "request_headers_user_agent",
            "response_status", "response_body_size", "response_headers_content_type", "response_headers_content_length",
            *(f"request_headers_{h}" for h in _FLAT_SENT), *(f"response_headers_{h}" for h in _FLAT_GOT)}
    parts = [f"{special.get(n) or (n if n in kept else DEFAULTS[NORMALISED[n][0]])} AS {n}" for n in NORMALISED]
    return "SELECT " + ", ".join(parts) + f" FROM access WHERE request_host <> '{_OWN_HOST}' AND platform_topic <> 'log'"


@check("norm_cloudflare", views("access", _flat_sql()))
def _(spark, sf):
    return plain_times(normalize.normalise_flat(raw_flat(spark, sf), [_OWN_HOST], [("%.example.page", "Cloudflare / Own")]))


@check("src_flat_headers", views("access", "SELECT request_host AS host, request_headers_via AS via, response_headers_vary AS vary FROM access"))
def _(spark, sf):
    path = shared_folder(spark, "flat")
    raw_flat(spark, sf).write.option("compression", "gzip").json(path)
    rows = readers.read_json_lines(spark, path, FLAT_HEADERS)

    def header(column: str, name: str) -> Column:
        return F.coalesce(F.get_json_object(column, f"$.{name}"), F.lit(""))

    return rows.select(F.col("ClientRequestHost").alias("host"), header("RequestHeaders", "via").alias("via"),
                       header("ResponseHeaders", "vary").alias("vary"))


def _normalised(spark, sf) -> DataFrame:
    parts = [normalize.normalise_service(raw_service(spark, sf, x), x) for x in SERVICES]
    return normalize.union_normalised([*parts, normalize.normalise_flat(raw_flat(spark, sf))])


@check("union_normalised", views("access", " UNION ALL ".join(
    [f"SELECT 'fastly' AS source, platform_backend_type, count(*) AS n, count(*) AS hosts, sum(response_status)::BIGINT AS statuses FROM ({_service_sql(x)}) GROUP BY 2"
     for x in SERVICES if x not in ("generic", "media")]
    + [f"SELECT 'fastly', platform_backend_type, count(*), count(*), sum(response_status)::BIGINT FROM ({_service_sql('generic')} UNION ALL {_service_sql('media')}) GROUP BY 2",
       "SELECT 'cloudflare', 'Cloudflare / Workers', count(*), count(*), sum(response_status)::BIGINT FROM access WHERE platform_topic <> 'log'"])))
def _(spark, sf):
    return _normalised(spark, sf).groupBy("source", "platform_backend_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("request_headers_accept").alias("hosts"),
        F.sum("response_status").cast("bigint").alias("statuses"))


# --- fan-out, sampling, dictionaries ----------------------------------------

_ADMIN_HOSTS = ("main--site3--org3.example.live", "main--site3--org3.example.page")
_AUTHORING_HOSTS = ("main--site7--org2.example.live",)
_ADMIN_IN = "request_host IN ('main--site3--org3.example.live', 'main--site3--org3.example.page')"
_AUTHORING_IN = "request_host = 'main--site7--org2.example.live'"


@check("route_fanout", views("access", f"""
    SELECT 'delivery' AS target, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w FROM access WHERE cdn_is_edge AND NOT {_ADMIN_IN} AND NOT {_AUTHORING_IN}
    UNION ALL SELECT 'delivery_errors', count(*), CAST(sum(weight) AS BIGINT) FROM access WHERE cdn_is_edge AND response_status >= 500 AND NOT {_ADMIN_IN} AND NOT {_AUTHORING_IN}
    UNION ALL SELECT 'admin', count(*), CAST(sum(weight) AS BIGINT) FROM access WHERE {_ADMIN_IN}
    UNION ALL SELECT 'backend', count(*), CAST(sum(weight) AS BIGINT) FROM access WHERE NOT cdn_is_edge AND NOT {_ADMIN_IN} AND NOT {_AUTHORING_IN}
    UNION ALL SELECT 'authoring', count(*), CAST(sum(weight) AS BIGINT) FROM access WHERE {_AUTHORING_IN}"""))
def _(spark, sf):
    targets = rollup.route(v.access(spark, sf), rollup.routes(_ADMIN_HOSTS, _AUTHORING_HOSTS))
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").cast("bigint").alias("w")).select(F.lit(t).alias("target"), "n", "w")
             for t, df in targets.items()]
    return reduce(DataFrame.unionByName, parts)


@check("sample_hash_mod", views("access", """
    SELECT event_id, CAST(10 AS BIGINT) AS weight FROM access
    WHERE ('0x' || substr(md5(CAST(epoch_us(timestamp) // 1000 AS VARCHAR) || ':' || cdn_originating_ip), 1, 8))::BIGINT % 10 = 0"""))
def _(spark, sf):
    # The hash is free to choose; this one exists in both engines.
    key = F.conv(F.substring(F.md5(rollup.time_and_address()), 1, 8), 16, 10).cast("bigint")
    sampled = rollup.thin_out(v.access(spark, sf), 10, key)
    return sampled.select("event_id", F.col("weight").cast("bigint").alias("weight"))


_KEY_SQL = "('0x' || substr(md5(ray_id || '/' || event_id), 1, 8))::BIGINT"


@check("sample_key", views("access", "SELECT request_method, " + ", ".join(
    f"CAST({c} * 4 AS BIGINT) AS {c}" for c in ("cnt", "cnt_ok", "cnt_4xx", "cnt_5xx"))
    + f" FROM (SELECT request_method, {counters()} FROM access WHERE {_KEY_SQL} % 4 < 1 GROUP BY 1)"))
def _(spark, sf):
    # A quarter of the sample space, scaled up; the stored hash may be any.
    text = F.concat_ws("/", "ray_id", F.col("event_id").cast("string"))
    keyed = v.access(spark, sf).withColumn("sample_hash", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"))
    counted = readers.sample(keyed, 1, 4).groupBy("request_method").agg(*traffic_counters(DELIVERY))
    return counted.select("request_method", *rollup.scaled_counters(("cnt", "cnt_ok", "cnt_4xx", "cnt_5xx"), 1, 4))


@check("sample_pruned", views("access", "SELECT request_method, " + ", ".join(
    f"CAST({c} * 5 AS BIGINT) AS {c}" for c in ("cnt", "cnt_ok", "cnt_4xx", "cnt_5xx"))
    + f" FROM (SELECT request_method, {counters()} FROM access WHERE {_KEY_SQL} % 1048576 < 209716 GROUP BY 1)"))
def _(spark, sf):
    """A fifth of the sample space, read from a table whose folders are samples."""
    path, text = shared_folder(spark, "sampled"), F.concat_ws("/", "ray_id", F.col("event_id").cast("string"))
    key = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    writers.write_sampled(v.access(spark, sf), path, key)
    counted = readers.sample_pruned(spark.read.parquet(path), 1, 5).groupBy("request_method").agg(*traffic_counters(DELIVERY))
    return counted.select("request_method", *rollup.scaled_counters(("cnt", "cnt_ok", "cnt_4xx", "cnt_5xx"), 1, 5))


_PATTERNS_SQL = {name: p.replace("'", "''") for name, p in ENTITY_PATTERNS.items()}
_PATTERNS_SQL["ips"] = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


@check("extract_entities", views("app_log", "SELECT doc_id, " + ", ".join(
    f"array_to_string(regexp_extract_all(message, '{p}'), ' | ') AS {n}" for n, p in _PATTERNS_SQL.items())
    + f", {DUCK_DIMS['admin-method']} AS admin_method FROM app_log"))
def _(spark, sf):
    rows = with_entities(v.app_log_in(spark, sf))
    return rows.select("doc_id", *[F.concat_ws(" | ", n).alias(n) for n in ENTITY_PATTERNS],
                       F.expr("coalesce(try_variant_get(message_json, '$.admin.method', 'string'), '')").alias("admin_method"))


@check("build_asn_map", views("access", """
    SELECT client_asn AS asn, arg_max(client_name, timestamp) AS name, max(timestamp) AS last_seen FROM access
    WHERE client_name <> '' AND client_asn > 0 GROUP BY 1"""))
def _(spark, sf):
    return lookups.name_of_number(v.access(spark, sf), "client_asn", "client_name", "timestamp")


@check("rollup_merge", views("access", f"""
    SELECT date_trunc('minute', timestamp) AS minute, 'method' AS facet, request_method AS dim, {counters()} FROM access GROUP BY 1, 3"""))
def _(spark, sf):
    df, facets = v.access(spark, sf), {"method": "request_method"}
    halves = [df.filter("cdn_is_edge"), df.filter("NOT cdn_is_edge")]
    return rollup.merge_rollups(*[rollup.minute_rollup(h, DELIVERY, facets) for h in halves])


@check("retention", views("access", """
    SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM access WHERE timestamp >= TIMESTAMP '2024-01-17' GROUP BY 1"""))
def _(spark, sf):
    kept = writers.expire(v.access(spark, sf), readers.RETENTION["facts"], v.AS_OF)
    return kept.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@check("scan_fact", views("access", """
    SELECT request_host, count(*) AS n FROM access
    WHERE timestamp >= TIMESTAMP '2024-01-10 06:00:00' AND timestamp < TIMESTAMP '2024-01-20 18:01:00' GROUP BY 1"""))
def _(spark, sf):
    path = shared_folder(spark, "facts")
    writers.write_facts(v.access(spark, sf), path)
    rng = TimeRange.free(datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18))
    return readers.read_facts(spark, path, rng).groupBy("request_host").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ------------------------------------------------------------------

@check("sink_append", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path, events = shared_folder(spark, "append"), v.table(spark, sf, "events")
    errors = F.col("event_type") == "error"
    writers.append_rows(events.filter(errors), path)
    writers.append_rows(events.filter(~errors), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@check("sink_compact", """
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    path = shared_folder(spark, "compact")
    orders = v.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    writers.compact_versions(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], path)
    return spark.read.parquet(path)


@check("sink_json", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    path = shared_folder(spark, "json")
    writers.write_json(v.table(spark, sf, "customer"), path)
    return readers.read_json_lines(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@check("sink_tsv", views("access", f"""SELECT CASE WHEN dim = '' THEN '(empty)' ELSE dim END AS "Value", CAST(cnt AS VARCHAR) AS "Count",
    CAST(cnt_ok AS VARCHAR) AS "OK (2xx/3xx)", CAST(cnt_4xx AS VARCHAR) AS "4xx", CAST(cnt_5xx AS VARCHAR) AS "5xx"
    FROM ({sql_breakdown('access', 'response_headers_content_type', n=10)}) WHERE kind = 'value'"""))
def _(spark, sf):
    path = shared_folder(spark, "tsv")
    writers.write_tsv(bd.breakdown(v.access(spark, sf), DELIVERY, DELIVERY.facets["content-types"], MONTH), path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@check("sink_nested_row", views("access", """
    SELECT event_id, '{' || concat_ws(',', '"event_id":' || event_id,
      '"request":{"host":"' || request_host || '","method":"' || request_method || '"'
        || CASE WHEN request_headers_via = '' THEN '' ELSE ',"headers":{"via":"' || request_headers_via || '"}' END || '}',
      CASE WHEN response_headers_x_error <> '' THEN '"response":{"headers":{"x_error":"' || response_headers_x_error || '"}}' END,
      CASE WHEN cdn_cache_status <> '' THEN '"cdn":{"cache_status":"' || cdn_cache_status || '"}' END) || '}' AS json FROM access"""))
def _(spark, sf):
    rows = v.access(spark, sf).select("event_id", "request_host", "request_method", "request_headers_via",
                                      "response_headers_x_error", "cdn_cache_status")
    return rows.select("event_id", writers.nested_json(rows).alias("json"))


# --- configuration dump -----------------------------------------------------

_DUMP_JSON = """concat('{{"org', c_nationkey, '":{{"config":{{"version":', c_custkey, ',"created":"2023-01-02T03:04:05Z"}},"{kind}":{{"', c_name,
  '":{{"data":{{"version":"', CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '7' END, '","created":"2024-05-06T07:08:09Z",',
  '"code":{{"owner":"o', c_custkey % 5, '","source":{{"type":"t","url":"', CASE c_custkey % 3 WHEN 0 THEN 'https://github.com/a' WHEN 1 THEN '' ELSE 'https://x.org/a' END, '"}}}},',
  '"content":{{"source":{{"type":"s","url":"', CASE c_custkey % 2 WHEN 0 THEN 'https://api.example.live/a' ELSE 'https://else.example.com' END, '"}}}},',
  '"folders":', CASE c_custkey % 2 WHEN 0 THEN '{{}}' ELSE '{{"/":"a"}}' END, ',"features":{{"f":', c_custkey, '}}',
  CASE c_custkey % 4 WHEN 0 THEN ',"extends":{{"profile":"p1"}}' ELSE '' END, '}}}}}}}}}}') """


def _orgs(spark, sf, kind: str) -> DataFrame:
    """One dump line per customer, as a dump of many organisations would have."""
    text = _DUMP_JSON.format(kind=kind)
    return config_dump.read_orgs(v.table(spark, sf, "customer").selectExpr(f"{text} AS orgs"))


_CONFIG_SQL = """SELECT 'org' || c_nationkey AS org, c_name AS {key}, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 7 END AS version,
    TIMESTAMP '2024-05-06 07:08:09' AS created, TIMESTAMP '1970-01-01' AS last_modified, 'o' || (c_custkey % 5) AS code_owner, '' AS code_repo,
    CASE c_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 't' ELSE 'byogit' END AS code_source_type,
    CASE c_custkey % 3 WHEN 0 THEN 'https://github.com/a' WHEN 1 THEN '' ELSE 'https://x.org/a' END AS code_source_url, '' AS content_bus_id,
    CASE c_custkey % 2 WHEN 0 THEN 'source' ELSE 's' END AS content_source_type,
    CASE c_custkey % 2 WHEN 0 THEN 'https://api.example.live/a' ELSE 'https://else.example.com' END AS content_source_url,
    '' AS content_source_overlay_type, '' AS content_source_overlay_url, '' AS cdn_prod_host, '' AS cdn_prod_type,
    c_custkey % 2 = 1 AS folders, '{{"f":' || c_custkey || '}}' AS features, '{{}}' AS limits{more} FROM customer"""


@check("src_config_dump", """SELECT 'org' || c_nationkey AS org, c_custkey AS version, TIMESTAMP '2023-01-02 03:04:05' AS created,
    TIMESTAMP '1970-01-01' AS last_modified FROM customer""")
def _(spark, sf):
    return plain_times(config_dump.org_rows(_orgs(spark, sf, "sites")))


@check("config_rows", _CONFIG_SQL.format(key="site", more=", CASE WHEN c_custkey % 4 = 0 THEN 'p1' ELSE '' END AS profile"))
def _(spark, sf):
    return plain_times(config_dump.site_rows(_orgs(spark, sf, "sites")))


@check("config_rows_profiles", _CONFIG_SQL.format(key="profile", more=""))
def _(spark, sf):
    return plain_times(config_dump.profile_rows(_orgs(spark, sf, "profiles")))


# --- streaming --------------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    schema = v.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _access_stream(spark, sf) -> DataFrame:
    return v._view(_event_stream(spark, sf), v.ACCESS)


FACETS = {"method": "request_method", "status_range": "concat(response_status div 100, 'xx')"}
_ST_ROLLUP = " UNION ALL ".join(
    f"SELECT date_trunc('minute', timestamp) AS minute, '{n}' AS facet, {d} AS dim, {counters()} FROM access{{where}} GROUP BY 1, 3"
    for n, d in (("method", "request_method"), ("status_range", DUCK_STATUS_RANGE)))


@check("st_rollup", views("access", _ST_ROLLUP.format(where="")))
def _(spark, sf):
    path = shared_folder(spark, "stream-rollup")
    jobs.start_rollup(_access_stream(spark, sf), DELIVERY, FACETS, f"{path}/rows", f"{path}/checkpoint", "edge").awaitTermination()
    return rollup.merge_rollups(jobs.read_batches(spark, f"{path}/rows"))


_ROUTED = {"delivery": "cdn_is_edge", "delivery_errors": "cdn_is_edge AND response_status > 499", "backend": "NOT cdn_is_edge"}
_ST_COLUMNS = ", ".join(v.ACCESS)


def _ingested(spark, sf) -> str:
    """Two sources, each with its own checkpoint, feed the same tables."""
    path = shared_folder(spark, "stream-ingest")
    rules = {t: r for t, r in rollup.routes((), ()).items() if t in _ROUTED}
    for source, condition in (("errors", "event_type = 'error'"), ("others", "event_type <> 'error'")):
        jobs.start_ingest(_event_stream(spark, sf).filter(condition), lambda rows: v._view(rows, v.ACCESS), f"{path}/facts", rules,
                          f"{path}/checkpoint-{source}", source, "delivery", f"{path}/rollup", DELIVERY, FACETS).awaitTermination()
    return path


@check("st_ingest", views("access", " UNION ALL ".join(f"SELECT '{t}' AS target, {_ST_COLUMNS} FROM access WHERE {c}" for t, c in _ROUTED.items())))
def _(spark, sf):
    path = _ingested(spark, sf)
    rows = [jobs.read_batches(spark, f"{path}/facts", t).select(F.lit(t).alias("target"), *v.ACCESS) for t in _ROUTED]
    return reduce(DataFrame.unionByName, rows)


_RATES = {"delivery": 10, "backend": 4}  # the errors are kept whole
_HASHED = "('0x' || substr(md5(CAST(epoch_us(timestamp) // 1000 AS VARCHAR) || ':' || cdn_originating_ip), 1, 8))::BIGINT"
_ST_SAMPLED = " UNION ALL ".join(
    f"SELECT '{t}' AS target, {', '.join(c if c != 'weight' else str(_RATES.get(t, 1)) + '::BIGINT AS weight' for c in v.ACCESS)} FROM access "
    f"WHERE {c} AND {_HASHED} % {_RATES.get(t, 1)} = 0" for t, c in _ROUTED.items())


def _ingested_sampled(spark, sf) -> str:
    """One stream with a rate of its own for each target; some of its batches have no rows that are kept."""
    path = shared_folder(spark, "stream-sampled")
    rules = {t: r for t, r in rollup.routes((), ()).items() if t in _ROUTED}
    key = F.conv(F.substring(F.md5(rollup.time_and_address()), 1, 8), 16, 10).cast("bigint")
    none, every = F.lit(False), _event_stream(spark, sf)
    for source, stream in (("edge", every), ("idle", every.filter("event_id < 0")), ("unmet", every)):
        met = {t: none for t in rules} if source == "unmet" else rules
        jobs.start_ingest(stream, lambda rows: v._view(rows, v.ACCESS), f"{path}/facts", met, f"{path}/checkpoint-{source}", source,
                          "delivery", f"{path}/rollup", DELIVERY, FACETS, rates=lambda: _RATES, key=key).awaitTermination()
    return path


@check("st_ingest_sampled", views("access", _ST_SAMPLED))
def _(spark, sf):
    path = _ingested_sampled(spark, sf)
    rows = [jobs.read_batches(spark, f"{path}/facts", t).select(F.lit(t).alias("target"), *v.ACCESS) for t in _ROUTED]
    return reduce(DataFrame.unionByName, rows)


@check("st_ingest_sampled_rollup", views("access", " UNION ALL ".join(
    f"SELECT date_trunc('minute', timestamp) AS minute, '{n}' AS facet, {d} AS dim, 10 * count(*) AS cnt, 10 * count(*) FILTER (WHERE response_status < 400) AS cnt_ok, "
    f"10 * count(*) FILTER (WHERE response_status BETWEEN 400 AND 499) AS cnt_4xx, 10 * count(*) FILTER (WHERE response_status > 499) AS cnt_5xx "
    f"FROM access WHERE cdn_is_edge AND {_HASHED} % 10 = 0 GROUP BY 1, 3" for n, d in (("method", "request_method"), ("status_range", DUCK_STATUS_RANGE)))))
def _(spark, sf):
    """The sampled target's roll-up counts what its rows stand for."""
    return rollup.merge_rollups(jobs.read_batches(spark, f"{_ingested_sampled(spark, sf)}/rollup"))


@check("st_ingest_rollup", views("access", _ST_ROLLUP.format(where=" WHERE cdn_is_edge")))
def _(spark, sf):
    return rollup.merge_rollups(jobs.read_batches(spark, f"{_ingested(spark, sf)}/rollup"))


_COMPACTED = [date(2024, 1, d) for d in range(1, 13)]


@check("st_compacted", views("access", f"SELECT {_ST_COLUMNS} FROM access WHERE cdn_is_edge AND CAST(timestamp AS DATE) BETWEEN '2024-01-01' AND '2024-01-12'"))
def _(spark, sf):
    """The streamed batches of some days rewritten as facts, one day of them twice."""
    path = _ingested(spark, sf)
    for days in (_COMPACTED, _COMPACTED[3:4]):
        jobs.compact_batches(spark, f"{path}/facts", f"{path}/days", days, "delivery")
    return spark.read.parquet(f"{path}/days").select(*v.ACCESS)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _live(spark, sf, root: str) -> LiveTable:
    return LiveTable(root, _ddl(v.access(spark, sf)), target="delivery")


@check("st_compacted_live", views("access", f"SELECT {_ST_COLUMNS} FROM access WHERE cdn_is_edge"))
def _(spark, sf):
    """Days are compacted while batches come: early rows, a compaction (run twice), late rows of the same days, a
    compaction of one of them, more late rows, and the covered folders dropped."""
    path = shared_folder(spark, "stream-live")
    table, rules = _live(spark, sf, path), {"delivery": rollup.routes((), ())["delivery"]}

    def ingest(source: str, condition: str) -> None:
        jobs.start_ingest(_event_stream(spark, sf).filter(condition), lambda rows: v._view(rows, v.ACCESS), table.batches, rules,
                          f"{path}/checkpoint-{source}", source).awaitTermination()
    ingest("early", "event_id % 4 < 2")
    for _ in range(2):
        table.compact(spark, _COMPACTED, "first")
    ingest("late", "event_id % 4 = 2")
    table.compact(spark, _COMPACTED[3:4], "second")
    ingest("later", "event_id % 4 = 3")
    table.drop_covered(spark)
    return table.read(spark).select(*v.ACCESS)


@check("st_rollup_live", views("access", _ST_ROLLUP.format(where="")))
def _(spark, sf):
    """Partial sums folded by compaction and read together with those that came since."""
    path = shared_folder(spark, "rollup-live")
    table = LiveTable(path, "minute timestamp_ntz, facet string, dim string, cnt bigint, cnt_ok bigint, cnt_4xx bigint, cnt_5xx bigint",
                      time="minute", sort=("facet",), merge=rollup.merge_rollups)
    for part, name in enumerate(("first", "second")):
        jobs.start_rollup(_access_stream(spark, sf).filter(F.col("event_id") % 2 == part), DELIVERY, FACETS, table.batches, f"{path}/checkpoint-{part}", name).awaitTermination()
        table.compact(spark, _COMPACTED, name)
    return rollup.merge_rollups(table.read(spark).drop(jobs.DAY))


@check("st_rollup_compacted", views("access", f"SELECT * FROM ({_ST_ROLLUP.format(where='')}) WHERE CAST(minute AS DATE) BETWEEN '2024-01-01' AND '2024-01-12'"))
def _(spark, sf):
    path = shared_folder(spark, "stream-rollup")
    jobs.start_rollup(_access_stream(spark, sf), DELIVERY, FACETS, f"{path}/rows", f"{path}/checkpoint", "edge").awaitTermination()
    for days in (_COMPACTED, _COMPACTED[:1]):
        rollup.compact_rollup(jobs.read_batches(spark, f"{path}/rows"), f"{path}/days", days)
    return spark.read.parquet(f"{path}/days").drop("dt")


@check("retention_drop", views("access", f"SELECT {_ST_COLUMNS} FROM access WHERE CAST(timestamp AS DATE) >= DATE '2024-01-17'"))
def _(spark, sf):
    path = shared_folder(spark, "retention")
    writers.write_facts(v.access(spark, sf), path)
    for _ in range(2):
        writers.drop_expired(spark, path, readers.RETENTION["facts"], v.AS_OF)
    return spark.read.parquet(path).select(*v.ACCESS)


@check("st_latest", """
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def _(spark, sf):
    path = shared_folder(spark, "stream-versions")
    stream = _event_stream(spark, sf).select("user_id", "event_id", "event_type")
    jobs.start_versions(stream, f"{path}/rows", f"{path}/checkpoint", "users").awaitTermination()
    return jobs.read_versions(spark.read.parquet(f"{path}/rows"), ["user_id"], "event_id")


@check("st_enrich", views("access", """
    SELECT client_asn, coalesce(n_name, '') AS name, count(*) AS n FROM access LEFT JOIN nation ON client_asn = n_nationkey GROUP BY 1, 2"""))
def _(spark, sf):
    path = shared_folder(spark, "stream-names")

    def names() -> DataFrame:
        return v.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("client_asn"), F.col("n_name").alias("name"))

    stream = _access_stream(spark, sf).select("event_id", "client_asn")
    jobs.start_enriched(stream, names, "client_asn", f"{path}/rows", f"{path}/checkpoint", "edge").awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("client_asn", "name").agg(F.count(F.lit(1)).alias("n"))


@check("st_windowed_rollup", views("access", f"""
    SELECT minute, facet, dim, cnt, cnt_ok, cnt_4xx, cnt_5xx FROM ({_ST_ROLLUP.format(where="")})
    WHERE minute + INTERVAL 1 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE"""))
def _(spark, sf):
    """Only minutes the watermark has closed are final; the rest stays open."""
    path = shared_folder(spark, "stream-windowed")
    # Watermarks need timestamps with time zone.
    stream = _access_stream(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rolled = jobs.windowed_rollup(stream, DELIVERY, FACETS, timedelta(minutes=10))
    query = (rolled.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint")
             .option("path", f"{path}/rows").trigger(availableNow=True).start())
    query.awaitTermination()
    return plain_times(spark.read.parquet(f"{path}/rows"))
