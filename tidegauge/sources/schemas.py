"""Schemas of the staging records and tables, as Spark DDL text.

Staging records of the CDN services nest their values. The struct that holds
the platform's own routing fields has a name chosen by the platform; readers
and normalisers take it as ``platform_field``.
"""

from __future__ import annotations

PLATFORM_FIELD = "platform"


def _struct(*parts: str) -> str:
    return "struct<" + ", ".join(parts) + ">"


def _texts(names: str) -> str:
    return ", ".join(f"`{n}`: string" for n in names.split())


CLIENT = _struct(_texts("city_name country_name ip name"), "number: bigint")
CDN_CORE = "time_elapsed_msec: double, " + _texts("datacenter region_code version")
CDN_SEEN = CDN_CORE + ", " + _texts("originating_ip url")
CDN_CACHED = CDN_SEEN + ", cache_status: string, cache_ttl: double, is_edge: boolean"
CERTIFIED_CLIENT = _struct(
    "certificate: " + _struct(_texts("dn is_expired is_unknown_ca is_verified issuer_dn")),
    _texts("city_name country_name ip name"), "number: bigint")
REQUEST_CORE = _texts("host method protocol url")
API_REQUEST_HEADERS = _texts(
    "accept accept_encoding accept_language access_control_request_headers access_control_request_method "
    "cache_control cookie if_modified_since origin referer user_agent via x_admin_version x_forwarded_for "
    "x_forwarded_host")
API_RESPONSE_HEADERS = _texts(
    "access_control_allow_methods access_control_allow_origin access_control_max_age content_encoding "
    "content_type last_modified location x_error x_invocation_id x_ratelimit_limit x_ratelimit_rate "
    "x_retry_after x_severity")


def _record(cdn: str, client: str | None, platform: str | None, request: str, response_headers: str,
            last_modified: str = "") -> str:
    headers = response_headers + (f", last_modified: {last_modified}" if last_modified else "")
    parts = ["cdn: " + _struct(cdn)]
    if client:
        parts.append("client: " + client)
    if platform:
        parts.append("{platform}: " + _struct(platform))
    parts.append("request: " + request)
    parts.append("response: " + _struct("body_size: bigint", "headers: " + _struct(headers), "status: string"))
    return _struct(*parts)


def _request(headers: str, *more: str) -> str:
    return _struct("headers: " + _struct(headers), REQUEST_CORE, *more)


# The fields each service logs.
RECORDS = {
    "generic": _record(
        CDN_CACHED, CLIENT, _texts("backend_type contentbus_prefix request_type"),
        _request(_texts("accept_encoding accept_language akamai_origin_hop cache_control cdn_loop fastly_ff "
                        "fastly_orig_accept_encoding range referer user_agent via x_abuse_info "
                        "x_browser_validation x_byo_cdn_type x_forwarded_for x_forwarded_host "
                        "x_push_invalidation") + ", if_modified_since: timestamp",
                 _texts("backend qs"), "body_size: bigint, is_mixed_case: boolean, restarts: bigint"),
        _texts("cache_control cache_tag cdn_cache_control content-range content_encoding content_length "
               "content_type edge_cache_tag edge_control location surrogate_control surrogate_key vary x_audit "
               "x_error x_robots_tag x_surrogate_key x_warning"), "timestamp"),
    "www": _record(
        CDN_CACHED, CLIENT, None,
        _request(_texts("accept_encoding accept_language cache_control fastly_ff fastly_orig_accept_encoding "
                        "if_modified_since referer user_agent via x_abuse_info x_forwarded_for "
                        "x_forwarded_host"),
                 _texts("backend qs"), "body_size: bigint, restarts: bigint"),
        _texts("cache_control content_encoding content_type location surrogate_key vary x_error "
               "x_robots_tag"), "string"),
    "admin": _record(
        CDN_SEEN, CERTIFIED_CLIENT, _texts("owner ref repo route"),
        _request(API_REQUEST_HEADERS, "body_size: bigint"), API_RESPONSE_HEADERS),
    "static": _record(
        CDN_CORE, CLIENT,
        _texts("backend_type contentbus_id contentbus_prefix org owner path ref repo request_type site"),
        _request(_texts("accept_encoding cdn_loop fastly_ff fastly_orig_accept_encoding via x_forwarded_host"),
                 _texts("backend"), "restarts: bigint"),
        _texts("content_encoding content_type location surrogate_key vary x_error"), "string"),
    "config": _record(
        CDN_CACHED, CERTIFIED_CLIENT, _texts("backend_type rso scope"),
        _request(_texts("accept_encoding accept_language cache_control cdn_loop fastly_ff "
                        "fastly_orig_accept_encoding if_modified_since referer user_agent via x_byo_cdn_type "
                        "x_forwarded_for x_forwarded_host x_push_invalidation"),
                 _texts("backend qs"), "body_size: bigint, restarts: bigint"),
        _texts("cache_control content_encoding content_type location server_timing surrogate_control "
               "surrogate_key vary x_error"), "string"),
    "media": _record(
        CDN_CACHED + ", fastly_error: string", CLIENT, _texts("backend_type blob_id contentbus_id"),
        _request(_texts("accept_encoding cache_control cdn_loop fastly_ff if_modified_since x_forwarded_for "
                        "x_forwarded_host"), _texts("backend qs"), "restarts: bigint"),
        _texts("accept_ranges cache_control content_encoding content_length content_range content_type etag "
               "fastly_io_error fastly_io_info fastly_io_served_by fastly_io_warning fastly_stats location "
               "surrogate_control surrogate_key transfer_encoding x_error"), "string"),
    "pipeline": _record(
        CDN_SEEN, None, _texts("backend_type contentbus_prefix org path ref request_type site"),
        _request(_texts("accept_encoding fastly_orig_accept_encoding origin x_forwarded_host"),
                 _texts("qs"), "restarts: bigint"),
        _texts("cache_control content_encoding content_type location surrogate_control surrogate_key vary "
               "x_error"), "string"),
    "api": _record(
        CDN_SEEN, CERTIFIED_CLIENT, _texts("org site topic"),
        _request(API_REQUEST_HEADERS, "body_size: bigint"), API_RESPONSE_HEADERS),
    "form": _struct("cdn: " + _struct(
        "client: " + CLIENT, _texts("datacenter originating_ip region_code"),
        "request: " + _request(_texts("content_length content_type referer user_agent x_forwarded_for "
                                      "x_forwarded_host"), _texts("backend"), "body_size: bigint"),
        "response: " + _struct("body_size: bigint", "headers: " + _struct(_texts("x_error")), "status: string"),
        "service_id: string", "time: " + _struct("elapsed: bigint", "end_msec: bigint", "start_msec: bigint"),
        _texts("url version"))),
}
SERVICES = tuple(RECORDS)


def staging_schema(service: str, platform_field: str = PLATFORM_FIELD) -> str:
    """Envelope plus nested record; forms call the record ``text``, others ``json``."""
    record = RECORDS[service].replace("{platform}", f"`{platform_field}`")
    severity = "bigint" if service == "generic" else "string"
    name = "text" if service == "form" else "json"
    # File path, name, size and time of the generic records are optional extras.
    extras = ", `_path` string, `_file` string, `_size` bigint, `_time` timestamp" if service == "generic" else ""
    return (f"`timestamp` bigint, applicationName string, subsystemName string, severity {severity}, "
            f"{name} {record}{extras}")


FLAT_HEADERS = ", ".join([
    "EdgeStartTimestamp bigint, ClientASN bigint, EdgeResponseStatus int, EdgeResponseBytes bigint, "
    "EdgeTimeToFirstByteMs bigint, CacheResponseBytes bigint, CacheResponseStatus int, "
    "OriginResponseStatus int, OriginResponseBytes bigint, OriginResponseTime bigint",
    *[f"{n} string" for n in (
        "RayID ZoneName ClientIP ClientCountry ClientRegionCode ClientRequestHost ClientRequestMethod "
        "ClientRequestURI ClientRequestProtocol ClientRequestReferer ClientRequestUserAgent CacheCacheStatus "
        "EdgeColoCode EdgeResponseContentType RequestHeaders ResponseHeaders ClientDeviceType ClientIPClass "
        "ClientMTLSAuthCertFingerprint ClientMTLSAuthStatus ClientRequestPath ClientRequestScheme "
        "ClientRequestSource ClientSSLCipher ClientSSLProtocol ClientXRequestedWith Cookies EdgePathingOp "
        "EdgePathingSrc EdgePathingStatus EdgeRateLimitAction EdgeRequestHost EdgeServerIP OriginIP "
        "OriginResponseHTTPExpires OriginResponseHTTPLastModified OriginSSLProtocol ParentRayID SecurityLevel "
        "WorkerStatus").split()],
    *[f"{n} int" for n in (
        "ClientSrcPort ClientTCPRTTMs EdgeColoID OriginDNSResponseTimeMs OriginRequestHeaderSendDurationMs "
        "OriginResponseDurationMs OriginResponseHeaderReceiveDurationMs OriginTCPHandshakeDurationMs "
        "OriginTLSHandshakeDurationMs SmartRouteColoID UpperTierColoID WorkerCPUTime "
        "WorkerSubrequestCount").split()],
    *[f"{n} bigint" for n in (
        "ClientRequestBytes EdgeEndTimestamp EdgeRateLimitID EdgeResponseBodyBytes WorkerWallTimeUs").split()],
    "CacheTieredFill boolean, EdgeCFConnectingO2O boolean, WorkerSubrequest boolean",
    "EdgeResponseCompressionRatio float",
    "ContentScanObjResults array<string>, ContentScanObjTypes array<string>",
])

TAIL = (
    "script_name string, event_timestamp bigint, outcome string, event_type string, data string")
APP_LOG_IN = (
    "timestamp timestamp, level string, message string, request_id string, function_name string, "
    "app_name string, subsystem string, log_stream string, log_group string")
ROLLUP = (
    "minute timestamp, facet string, dim string, cnt bigint, cnt_ok bigint, cnt_4xx bigint, cnt_5xx bigint")
RELEASES = (
    "published timestamp, repo string, tag string, url string, body string, _version bigint")
ASN_NAMES = (
    "asn bigint, name string, last_seen timestamp")
USER_SHIFTS = "user string, ical_url string"
SHIFTS = (
    "user string, shift_start timestamp, shift_end timestamp, summary string, uid string, _version bigint")

# Versioned configuration tables.
_SETTINGS = (
    "version int, created timestamp, last_modified timestamp, code_owner string, code_repo string, "
    "code_source_type string, code_source_url string, content_bus_id string, content_source_type string, "
    "content_source_url string, content_source_overlay_type string, content_source_overlay_url string, "
    "cdn_prod_host string, cdn_prod_type string, folders boolean, features string, limits string, _version bigint")
SITE_CONFIGS = f"org string, site string, profile string, {_SETTINGS}"
PROFILE_CONFIGS = f"org string, profile string, {_SETTINGS}"
ORG_CONFIGS = "org string, version int, created timestamp, last_modified timestamp, _version bigint"

# The normalised request table: column -> (type, default). Group prefixes are
# the dotted groups of the log format with "_" for ".".
_TEXT, _INT, _DOUBLE, _BOOL = ("string", ""), ("bigint", 0), ("double", 0.0), ("boolean", False)
REQUEST_HEADERS = (
    "accept_encoding", "accept_language", "cache_control", "cdn_loop", "referer", "user_agent", "via",
    "x_forwarded_for", "x_forwarded_host", "x_byo_cdn_type", "x_push_invalidation")
RESPONSE_HEADERS = (
    "cache_control", "content_type", "content_encoding", "vary", "location", "x_error", "x_surrogate_key",
    "edge_cache_tag", "edge_control")
EXTRA_REQUEST_HEADERS = (
    "accept", "accept_content", "cf_connecting_ip", "if_modified_since", "if_none_match", "range",
    "true_client_ip", "x_hipaa")
EXTRA_RESPONSE_HEADERS = (
    "cache_tag", "cdn_cache_control", "cf_resized", "content_range", "etag", "expires", "surrogate_control",
    "surrogate_key", "x_robots_tag")
NORMALISED: dict[str, tuple[str, object]] = {
    "timestamp": ("timestamp", None), "source": _TEXT,
    "cdn_cache_status": _TEXT, "cdn_cache_ttl": _DOUBLE, "cdn_datacenter": _TEXT, "cdn_is_edge": _BOOL,
    "cdn_originating_ip": _TEXT, "cdn_region_code": _TEXT, "cdn_time_elapsed_msec": _DOUBLE,
    "cdn_url": _TEXT, "cdn_version": _TEXT,
    "client_city_name": _TEXT, "client_country_name": _TEXT, "client_ip": _TEXT, "client_name": _TEXT,
    "client_asn": _INT,
    "platform_backend_type": _TEXT, "platform_contentbus_prefix": _TEXT, "platform_request_type": _TEXT,
    "request_backend": _TEXT, "request_body_size": _INT, "request_host": _TEXT, "request_method": _TEXT,
    "request_protocol": _TEXT, "request_url": _TEXT, "request_qs": _TEXT, "request_is_mixed_case": _BOOL,
    "request_restarts": _INT,
    **{f"request_headers_{h}": _TEXT for h in REQUEST_HEADERS},
    "response_status": ("int", 0), "response_body_size": _INT,
    **{f"response_headers_{h}": _TEXT for h in RESPONSE_HEADERS},
    "response_headers_content_length": _INT,
    "response_headers_last_modified": ("timestamp", "1970-01-01 00:00:00"),
    **{f"request_headers_{h}": _TEXT for h in EXTRA_REQUEST_HEADERS},
    **{f"response_headers_{h}": _TEXT for h in EXTRA_RESPONSE_HEADERS},
}
