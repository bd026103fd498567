"""Staging records of all services to the one normalised request table.

Which output columns a service fills follows from its staging schema: a value
the record has is taken, one it lacks gets the column's default. Only what
cannot be read off the schema is spelled out per service.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalars import (
    date_or_epoch, from_epoch_millis, from_epoch_nanos, text, unsigned_or_zero,
)
from tidegauge.sources.schemas import (
    EXTRA_REQUEST_HEADERS, EXTRA_RESPONSE_HEADERS, NORMALISED, PLATFORM_FIELD, REQUEST_HEADERS,
    RESPONSE_HEADERS,
)

# The backend label of each single-purpose service.
BACKEND_LABELS = {
    "admin": "Fastly / Admin", "api": "Fastly / API", "config": "Fastly / Config", "form": "Fastly / Forms",
    "media": "Fastly / Image Optimizer", "pipeline": "Fastly / Pipeline", "static": "Fastly / Static",
    "www": "Fastly / WWW",
}
# Host prefixes of the generic service's backends, in rule order.
# The trailing dot-separated labels are the platform's short domain names.
GENERIC_HOST_BACKENDS = (("admin", "Fastly / Admin"), ("api", "Fastly / API"), ("www", "Fastly / WWW"))
GENERIC_TYPE_BACKENDS = (("aws", "Fastly / AWS"), ("cloudflare", "Fastly / Cloudflare"))
OBJECT_STORE_HOSTS = ("%.r2.cloudflarestorage.com", "Cloudflare / R2")
WORKER_BACKEND = "Cloudflare / Workers"
WORKER_CACHE_SOURCE = "edgeWorkerCacheAPI"
BODY_IS_CONTENT = ("admin", "api", "config", "form", "pipeline", "static", "www")


class _Record:
    """Null-safe access to the fields a nested record has."""

    def __init__(self, schema: T.StructType, root: str):
        self.schema, self.root = schema, root

    def column(self, path: str) -> Column | None:
        kind: T.DataType = self.schema[self.root.split(".")[0]].dataType
        for name in [*self.root.split(".")[1:], *path.split(".")]:
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                return None
            kind = kind[name].dataType
        quoted = ".".join(f"`{p}`" for p in f"{self.root}.{path}".split("."))
        return F.col(quoted)

    def first(self, *paths: str) -> Column | None:
        return next((c for c in map(self.column, paths) if c is not None), None)


def _default(name: str) -> Column:
    kind, value = NORMALISED[name]
    return F.lit(value).cast(kind)


def _filled(name: str, column: Column | None) -> Column:
    kind, _ = NORMALISED[name]
    value = _default(name) if column is None else F.coalesce(column.cast(kind), _default(name))
    return value.alias(name)


def _joined(record: _Record, *paths: str) -> Column:
    return F.concat_ws("--", *[text(record.column(p)) for p in paths])


def _generic_backend(record: _Record, platform: str, domains: Iterable[str]) -> Column:
    host = text(record.column("request.host"))
    out = F.when(text(record.column(f"{platform}.request_type")) == "media", BACKEND_LABELS["media"])
    for prefix, label in GENERIC_HOST_BACKENDS:
        hit = reduce(lambda a, b: a | b, [host.startswith(f"{prefix}.{d}.") for d in domains])
        out = out.when(hit, label)
    for kind, label in GENERIC_TYPE_BACKENDS:
        out = out.when(text(record.column(f"{platform}.backend_type")) == kind, label)
    return out.otherwise("Fastly / Other")


def _platform_columns(service: str, record: _Record, platform: str,
                      domains: Iterable[str]) -> dict[str, Column | None]:
    at = platform
    prefix = record.column(f"{at}.contentbus_prefix")
    kind = record.column(f"{at}.request_type")
    if service == "admin":
        prefix, kind = _joined(record, f"{at}.ref", f"{at}.repo", f"{at}.owner"), record.column(f"{at}.route")
    elif service == "api":
        prefix, kind = _joined(record, f"{at}.org", f"{at}.site"), record.column(f"{at}.topic")
    elif service == "config":
        prefix, kind = record.column(f"{at}.rso"), record.column(f"{at}.scope")
    elif service == "media":
        prefix, kind = record.column(f"{at}.contentbus_id"), F.lit("media")
    elif service == "form":
        kind = F.lit("form")
    label = BACKEND_LABELS.get(service)
    return {
        "platform_backend_type": F.lit(label) if label else _generic_backend(record, at, domains),
        "platform_contentbus_prefix": prefix,
        "platform_request_type": kind,
    }


def normalise_service(raw: DataFrame, service: str, platform_field: str = PLATFORM_FIELD,
                      platform_domains: Iterable[str] = ("example",)) -> DataFrame:
    """One service's staging records as normalised requests."""
    record = _Record(raw.schema, "text.cdn" if service == "form" else "json")
    cdn = "" if service == "form" else "cdn."
    status = text(record.column("response.status"))
    values: dict[str, Column | None] = {
        "timestamp": from_epoch_millis(F.col("timestamp")),
        "source": F.lit("fastly"),
        "client_asn": record.column("client.number"),
        **_platform_columns(service, record, platform_field, platform_domains),
        "response_status": unsigned_or_zero(status, "int"),
        "response_body_size": record.column("response.body_size"),
        "response_headers_x_surrogate_key": record.first(
            "response.headers.x_surrogate_key", "response.headers.surrogate_key"),
        "response_headers_edge_control": record.first(
            "response.headers.edge_control", "response.headers.surrogate_control"),
    }
    for name in ("cache_status", "cache_ttl", "datacenter", "is_edge", "originating_ip", "region_code",
                 "time_elapsed_msec", "url", "version"):
        values[f"cdn_{name}"] = record.column(f"{cdn}{name}")
    for name in ("city_name", "country_name", "ip", "name"):
        values[f"client_{name}"] = record.column(f"client.{name}")
    for name in ("backend", "body_size", "host", "method", "protocol", "url", "qs", "is_mixed_case", "restarts"):
        values[f"request_{name}"] = record.column(f"request.{name}")
    for name in REQUEST_HEADERS:
        values[f"request_headers_{name}"] = record.column(f"request.headers.{name}")
    for name in RESPONSE_HEADERS:
        values.setdefault(f"response_headers_{name}", record.column(f"response.headers.{name}"))
    if service == "form":
        values["cdn_time_elapsed_msec"] = record.column("time.elapsed").cast("double") / 1000.0
    body = record.column("response.body_size")
    values["response_headers_content_length"] = (
        body if service in BODY_IS_CONTENT
        else unsigned_or_zero(text(record.column("response.headers.content_length"))))
    modified = record.column("response.headers.last_modified")
    if modified is not None and service != "generic":
        modified = date_or_epoch(modified)
    values["response_headers_last_modified"] = modified
    wanted = [n for n in NORMALISED if n in values]
    return raw.select(*[_filled(n, values[n]) for n in wanted])


def normalise_flat(raw: DataFrame, excluded_hosts: Iterable[str] = (),
                   host_backends: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Flat records with header JSON text as normalised requests.

    ``excluded_hosts`` is the log store's own traffic; ``host_backends`` are
    the platform's (LIKE pattern, label) rules, applied after the object store's.
    The two header texts are parsed once per row, not once per header.
    """
    host = text("ClientRequestHost")
    kept = raw.filter((text("ClientRequestSource") != WORKER_CACHE_SOURCE)
                      & (~host.isin(*excluded_hosts) if excluded_hosts else F.lit(True)))
    headers = kept.withColumns({
        "sent": F.from_json("RequestHeaders", "map<string,string>"),
        "got": F.from_json("ResponseHeaders", "map<string,string>"),
    })

    def sent(name: str) -> Column:
        return text(F.col("sent").getItem(name.replace("_", "-")))

    def got(name: str) -> Column:
        return text(F.col("got").getItem(name.replace("_", "-")))

    pattern, label = OBJECT_STORE_HOSTS
    backend = F.when(host.like(pattern), label)
    for rule, name in host_backends:
        backend = backend.when(host.like(rule), name)
    values: dict[str, Column] = {
        "timestamp": from_epoch_nanos(F.col("EdgeStartTimestamp")),
        "source": F.lit("cloudflare"),
        "cdn_cache_status": F.col("CacheCacheStatus"),
        "cdn_datacenter": F.col("EdgeColoCode"),
        "cdn_is_edge": F.lit(True),
        "cdn_originating_ip": F.col("ClientIP"),
        "cdn_region_code": F.col("ClientRegionCode"),
        "cdn_time_elapsed_msec": F.col("EdgeTimeToFirstByteMs"),
        "cdn_url": F.concat(F.lit("https://"), host, text("ClientRequestURI")),
        "client_country_name": F.col("ClientCountry"),
        "client_ip": F.col("ClientIP"),
        "client_asn": F.col("ClientASN"),
        "platform_backend_type": backend.otherwise(WORKER_BACKEND),
        "request_host": host,
        "request_method": F.col("ClientRequestMethod"),
        "request_protocol": F.col("ClientRequestProtocol"),
        "request_url": F.col("ClientRequestURI"),
        **{f"request_headers_{h}": sent(h) for h in (*REQUEST_HEADERS, *EXTRA_REQUEST_HEADERS)},
        "request_headers_referer": F.col("ClientRequestReferer"),
        "request_headers_user_agent": F.col("ClientRequestUserAgent"),
        "response_status": F.col("EdgeResponseStatus"),
        "response_body_size": F.col("EdgeResponseBytes"),
        **{f"response_headers_{h}": got(h) for h in (*RESPONSE_HEADERS, *EXTRA_RESPONSE_HEADERS)},
        "response_headers_content_type": F.col("EdgeResponseContentType"),
        "response_headers_content_length": unsigned_or_zero(got("content_length")),
        "response_headers_last_modified": date_or_epoch(got("last_modified")),
    }
    return headers.select(*[_filled(n, values.get(n)) for n in NORMALISED])


def union_normalised(parts: Iterable[DataFrame]) -> DataFrame:
    """All services in one table; columns a service never has get their defaults."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.select(*[F.coalesce(F.col(n), _default(n)).alias(n) if NORMALISED[n][1] is not None
                            else F.col(n) for n in NORMALISED if n in stacked.columns])


def normalise_tail(raw: DataFrame) -> DataFrame:
    """Worker tail envelopes with their event time."""
    return raw.withColumn("timestamp", from_epoch_millis(F.col("event_timestamp")))
