"""Facet catalogues of the log tables."""

from __future__ import annotations

from collections.abc import Iterable

from tidegauge.functions.buckets import (
    elapsed_buckets, elapsed_labels, rate_buckets, rate_labels, size_buckets, size_labels,
)
from tidegauge.functions.scalars import double_or_zero_sql, unsigned_or_zero_sql
from tidegauge.spec import Facet

# Path-like parts of error texts collapse to one placeholder.
ERROR_PATH = "/[a-zA-Z0-9/_.-]+"
GROUPED_ERROR = f"regexp_replace(response_headers_x_error, '{ERROR_PATH}', '/...')"
STATUS_RANGE = "concat(response_status div 100, 'xx')"
WRITES = "('POST', 'PUT', 'PATCH', 'DELETE')"
LIVE_SUFFIX = ".example.live"


def error_pattern(shown: str) -> str:
    """The LIKE pattern a grouped error text stands for."""
    return shown.replace("/...", "/%")


def network_number(shown: str) -> int:
    return int(shown.split(" ")[0])


def _catalogue(facets: Iterable[Facet]) -> dict[str, Facet]:
    return {f.name: f for f in facets}


def _plain(name: str, column: str, *, non_empty: bool = False, **options) -> Facet:
    """A facet on a column as it is, optionally without its empty value."""
    return Facet(name, column, extra=f"{column} != ''" if non_empty else None, **options)


def _status_range(**options) -> Facet:
    return Facet("status-range", STATUS_RANGE, summary="response_status >= 500",
                 dim_summary="dim = '5xx'", **options)


def _hosts(live_suffix: str, **options) -> Facet:
    return Facet("hosts", "request_host", summary=f"request_host LIKE '%{live_suffix}'",
                 dim_summary=f"dim LIKE '%{live_suffix}'", high_cardinality=True, **options)


def _methods(**options) -> Facet:
    return Facet("methods", "request_method", summary=f"request_method IN {WRITES}",
                 dim_summary=f"dim IN {WRITES}", **options)


def _errors(**options) -> Facet:
    return Facet("errors", GROUPED_ERROR, extra="response_headers_x_error != ''",
                 filter_col="response_headers_x_error", filter_value=error_pattern, filter_op="LIKE", **options)


def _asn(**options) -> Facet:
    return Facet("asn", "cast(client_asn AS string)", extra="client_asn != 0", filter_col="client_asn",
                 filter_value=network_number, by_bytes=True, dictionary=True, **options)


def _user_agents(**options) -> Facet:
    bots = "NOT {0} LIKE 'Mozilla/%' OR {0} LIKE '%+http%'"
    return Facet("user-agents", "request_headers_user_agent", high_cardinality=True,
                 summary=bots.format("request_headers_user_agent"), dim_summary=bots.format("dim"), **options)


def _ips(**options) -> Facet:
    return Facet("ips", "cdn_originating_ip", summary="cdn_originating_ip LIKE '%:%'",
                 dim_summary="dim LIKE '%:%'", high_cardinality=True, **options)


def _elapsed(name: str = "time-elapsed", raw: str = "cdn_time_elapsed_msec") -> Facet:
    return Facet(name, raw, raw=raw, buckets=elapsed_buckets, labels=elapsed_labels, summary=f"{raw} >= 1000")


def _content_length() -> Facet:
    return Facet("content-length", "response_headers_content_length", raw="response_headers_content_length",
                 buckets=size_buckets, labels=size_labels, by_bytes=True)


def _rate(name: str, column: str, raw: str) -> Facet:
    return Facet(name, raw, extra=f"{column} != ''", raw=raw, buckets=rate_buckets, labels=rate_labels)


# The facets of each table, in the order pages show them, with
# their columns, conditions and roll-up names.

def cdn_facets(live_suffix: str = LIVE_SUFFIX) -> dict[str, Facet]:
    """Facets of the delivery, backend and admin tables."""
    return _catalogue([
        _status_range(rollup="status_range"),
        Facet("source", "source", summary="source = 'fastly'", dim_summary="dim = 'fastly'", rollup="source"),
        _hosts(live_suffix, rollup="host"),
        Facet("forwarded-hosts", "request_headers_x_forwarded_host", rollup="x_forwarded_host",
              summary="request_headers_x_forwarded_host != ''", dim_summary="dim != ''", high_cardinality=True),
        _plain("content-types", "response_headers_content_type", rollup="content_type", by_bytes=True),
        Facet("status", "cast(response_status AS string)", rollup="status", by_bytes=True),
        _errors(rollup="x_error_grouped"),
        _plain("paths", "request_url", rollup="url", by_bytes=True, high_cardinality=True),
        _plain("referers", "request_headers_referer", rollup="referer", high_cardinality=True),
        _user_agents(rollup="user_agent"),
        _ips(rollup="originating_ip"),
        _plain("request-type", "platform_request_type", non_empty=True, rollup="request_type", by_bytes=True),
        _plain("tech-stack", "platform_backend_type", rollup="backend_type", by_bytes=True),
        Facet("tier", "platform_contentbus_prefix", extra="platform_contentbus_prefix != ''", rollup="tier",
              summary="platform_contentbus_prefix = 'live'", dim_summary="dim = 'live'"),
        _methods(rollup="method"),
        _plain("datacenters", "cdn_datacenter", rollup="datacenter", by_bytes=True),
        _asn(rollup="asn", rollup_exact=False),
        _plain("accept-encoding", "request_headers_accept_encoding", non_empty=True,
               rollup="accept_encoding", by_bytes=True),
        _plain("byo-cdn", "request_headers_x_byo_cdn_type", non_empty=True, rollup="byo_cdn", by_bytes=True),
        _plain("push-invalidation", "request_headers_x_push_invalidation", non_empty=True),
        _content_length(),
        _plain("location", "response_headers_location", non_empty=True, rollup="location", high_cardinality=True),
        _plain("content-encoding", "response_headers_content_encoding"),
        _plain("surrogate-key", "response_headers_x_surrogate_key", non_empty=True, high_cardinality=True),
        _elapsed(),
        _plain("subsystem", "subsystem", non_empty=True),
        _plain("rso", "platform_rso", non_empty=True),
        _plain("cdn-version", "cdn_version", non_empty=True),
        Facet("restarts", "cast(request_restarts AS string)"),
        _plain("route", "platform_route", non_empty=True),
        _plain("severity", "response_headers_x_severity", non_empty=True),
        _plain("topic", "platform_topic", non_empty=True),
        _plain("org", "platform_org", non_empty=True),
        _plain("site", "platform_site", non_empty=True, high_cardinality=True),
        _plain("repo", "platform_repo", non_empty=True, high_cardinality=True),
        _plain("owner", "platform_owner", non_empty=True, high_cardinality=True),
        _plain("path", "platform_path", non_empty=True, high_cardinality=True),
        _plain("ref", "platform_ref", non_empty=True),
        _plain("ratelimit-limit", "response_headers_x_ratelimit_limit", non_empty=True),
        _rate("ratelimit-rate", "response_headers_x_ratelimit_rate",
              unsigned_or_zero_sql("response_headers_x_ratelimit_rate")),
        _rate("delivery-ratelimit-rate", "response_headers_x_rate_limited_rate",
              double_or_zero_sql("response_headers_x_rate_limited_rate")),
    ])


def authoring_facets(live_suffix: str = LIVE_SUFFIX) -> dict[str, Facet]:
    """Facets of the authoring access table, which has no roll-up."""
    return _catalogue([
        _status_range(),
        _hosts(live_suffix),
        Facet("forwarded-hosts", "request_headers_x_forwarded_host", high_cardinality=True,
              summary="request_headers_x_forwarded_host != ''", dim_summary="dim != ''"),
        _plain("content-types", "response_headers_content_type", by_bytes=True),
        Facet("status", "cast(response_status AS string)", by_bytes=True),
        _errors(),
        _plain("paths", "request_url", by_bytes=True, high_cardinality=True),
        _plain("referers", "request_headers_referer", high_cardinality=True),
        _user_agents(),
        _ips(),
        _methods(),
        _plain("datacenters", "cdn_datacenter", by_bytes=True),
        _asn(),
        _plain("script-name", "cdn_script_name", non_empty=True),
        _plain("route", "platform_route", non_empty=True),
        _plain("owner", "platform_owner", non_empty=True, high_cardinality=True),
        _plain("repo", "platform_repo", non_empty=True, high_cardinality=True),
        _plain("accept-encoding", "request_headers_accept_encoding", non_empty=True, by_bytes=True),
        _content_length(),
        _plain("content-encoding", "response_headers_content_encoding"),
        _elapsed(),
    ])


def _array(name: str, column: str) -> Facet:
    """Counts every element of an array column; filters test membership."""
    return Facet(name, column, is_array=True, high_cardinality=True, filter_col=column, filter_op="HAS")


def worker_facets() -> dict[str, Facet]:
    return _catalogue([
        Facet("outcome", "outcome", summary="outcome IN ('exception', 'exceeded')",
              dim_summary="dim IN ('exception', 'exceeded')"),
        Facet("status", "cast(response_status AS string)"),
        _plain("script-name", "script_name"),
        _plain("method", "request_method"),
        _plain("url", "request_url", high_cardinality=True),
        _plain("script-version", "script_version", high_cardinality=True),
        Facet("ray-id", "ray_id", extra="ray_id != '' AND ray_id != '0'", high_cardinality=True),
        _array("logs", "logs"),
        _array("exceptions", "exceptions"),
    ])


# How a function's name and version are read from its full name.
FUNCTION_NAME = r"regexp_replace(function_name, r'/[^/]+\z', '')"
FUNCTION_VERSION = "split_part(function_name, '/', -1)"
ADMIN_METHOD = "coalesce(try_variant_get(message_json, '$.admin.method', 'string'), '')"
ADMIN_DURATION = double_or_zero_sql("try_variant_get(message_json, '$.admin.duration', 'string')")


def app_log_facets() -> dict[str, Facet]:
    return _catalogue([
        Facet("level", "level", summary="lower(level) = 'error'", dim_summary="lower(dim) = 'error'",
              rollup="level"),
        Facet("function-name", FUNCTION_NAME, rollup="function_name", high_cardinality=True),
        Facet("function-version", FUNCTION_VERSION, rollup="function_version", high_cardinality=True),
        _plain("app-name", "app_name", rollup="app_name"),
        _plain("subsystem", "subsystem", rollup="subsystem"),
        _plain("log-group", "log_group", rollup="log_group", high_cardinality=True),
        Facet("admin-method", ADMIN_METHOD, rollup="admin_method"),
        Facet("message", "left(message, 300)", high_cardinality=True),
        _plain("request-id", "request_id", high_cardinality=True),
        _array("url", "urls"),
        _array("path", "paths"),
        _array("ip", "ips"),
        _array("email", "emails"),
        _elapsed("admin-duration", ADMIN_DURATION),
    ])


# Roll-up facet name -> dim expression on the source table.
CDN_ROLLUP = {
    "datacenter": "cdn_datacenter",
    "request_type": "platform_request_type",
    "backend_type": "platform_backend_type",
    "content_type": "response_headers_content_type",
    "status": "cast(response_status AS string)",
    "accept": "request_headers_accept",
    "accept_encoding": "request_headers_accept_encoding",
    "cache_control": "request_headers_cache_control",
    "byo_cdn": "request_headers_x_byo_cdn_type",
    "x_error_grouped": GROUPED_ERROR,
    "method": "request_method",
    "cache_status": "upper(cdn_cache_status)",
    "status_range": STATUS_RANGE,
    "source": "source",
    "tier": "platform_contentbus_prefix",
}
APP_LOG_ROLLUP = {
    "level": "level",
    "function_name": FUNCTION_NAME,
    "function_version": FUNCTION_VERSION,
    "app_name": "app_name",
    "subsystem": "subsystem",
    "log_group": "log_group",
    "admin_method": ADMIN_METHOD,
}
