"""Class columns: each maps a dimension value to the family it belongs to.

The rules are ordered lists; the first that fits decides. An empty value has
the empty class. All are plain CASE expressions usable as breakdown dims.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CLASS = ""


def _ordered(value: Column, rules: Sequence[tuple[Column, str]], default: str = NO_CLASS) -> Column:
    out = F.when(F.coalesce(value, F.lit("")) == "", NO_CLASS)
    for condition, label in rules:
        out = out.when(condition, label)
    return out.otherwise(default)


def _prefixes(v: Column, table: dict[str, str]) -> list[tuple[Column, str]]:
    return [(v.startswith(k), label) for k, label in table.items()]


def _equals(v: Column, table: dict[str, str]) -> list[tuple[Column, str]]:
    return [(v == k, label) for k, label in table.items()]


def _contains(v: Column, table: dict[str, str]) -> list[tuple[Column, str]]:
    return [(v.contains(k), label) for k, label in table.items()]


# Fixed values.
MEDIA_FAMILIES = {"text/": "text", "application/": "application", "image/": "image",
                  "video/": "video", "font/": "font"}
CACHE_EXACT = {"PASS": "pass", "DYNAMIC": "dynamic", "REVALIDATED": "revalidated",
               "EXPIRED": "expired", "STALE": "stale"}
REQUEST_TYPES = ("pipeline", "static", "media", "rum", "html", "json", "md", "robots", "content",
                 "code", "job", "discover", "preview", "status", "sidekick", "github-bot", "live",
                 "auth", "admin", "delivery", "config")
METHODS = ("get", "post", "put", "patch", "head", "options", "delete")
EXTENSIONS = {
    "script": ("js", "mjs", "json", "css", "map"),
    "document": ("html", "htm", "pdf", "txt", "xml"),
    "image": ("png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico"),
    "media": ("mp4", "webm", "mov", "mp3", "wav", "ogg"),
    "font": ("woff", "woff2", "ttf", "otf", "eot"),
    "server": ("php", "asp", "aspx", "cgi", "jsp"),
}
BACKEND_TYPES = {
    "fastly / aws": "fastly-aws", "fastly / cloudflare": "fastly-cloudflare",
    "fastly / image optimizer": "fastly-media", "fastly / admin": "fastly-admin",
    "fastly / api": "fastly-api", "fastly / config": "fastly-config",
    "fastly / pipeline": "fastly-pipeline", "fastly / static": "fastly-static",
    "fastly / www": "fastly-www", "fastly / forms": "fastly-forms",
    "fastly / other": "fastly-other", "cloudflare / r2": "cf-r2",
    "cloudflare / workers": "cf-workers", "aws": "fastly-aws",
    "cloudflare": "cf-workers", "cloudflare (implied)": "cf-workers",
}
GOOD_NETWORKS = ("fastly", "akamai", "cloudflare", "amazon")
BAD_NETWORKS = ("zscaler", "incapsula")
CLOUD_NETWORKS = ("microsoft", "google")
SECURITY_ERRORS = ("not allowed", "access", "illegal", "unsupported")
CONTENT_ERRORS = ("content-bus", "failed to load")
STORAGE_ERRORS = ("s3:", "r2:")


def _any(v: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | v.contains(p)
    return hit


def status_class(value: Column) -> Column:
    """From the first digit: below 400 ok, below 500 client, else server error."""
    digit = F.regexp_extract(value.cast("string"), "^([0-9])", 1)
    return (F.when(digit == "", NO_CLASS).when(digit < "4", "ok")
            .when(digit < "5", "client-error").otherwise("server-error"))


def host_class(value: Column) -> Column:
    first = F.lower(F.trim(F.split_part(value, F.lit(","), F.lit(1))))
    return _ordered(value, [(first.endswith(".live"), "delivery"), (first.endswith(".page"), "authoring")],
                    "customer")


def content_type_class(value: Column) -> Column:
    return _ordered(value, _prefixes(F.lower(value), {**MEDIA_FAMILIES, "binary/": "binary"}))


def accept_class(value: Column) -> Column:
    v = F.lower(value)
    return _ordered(value, [*_prefixes(v, MEDIA_FAMILIES), (v == "*/*", "binary")])


def cache_status_class(value: Column) -> Column:
    v = F.upper(value)
    return _ordered(value, [(v.startswith("HIT"), "hit"), (v.startswith("MISS"), "miss"),
                            *_equals(v, CACHE_EXACT),
                            (v.startswith("ERROR"), "error"), (v == "UNKNOWN", "unknown")])


def request_type_class(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin(*REQUEST_TYPES), v).otherwise(NO_CLASS)


def backend_type_class(value: Column, own: dict[str, str] | None = None) -> Column:
    """``own`` adds the operator's own backend names."""
    return _ordered(value, _equals(F.lower(value), {**BACKEND_TYPES, **(own or {})}))


def method_class(value: Column) -> Column:
    v = F.lower(value)
    return F.when(v.isin(*METHODS), v).otherwise(NO_CLASS)


def network_class(value: Column, own: Sequence[str] = ()) -> Column:
    """Owner of an autonomous system; ``own`` names the operator's networks."""
    v = F.lower(value)
    return _ordered(value, [(_any(v, own), "own"), (_any(v, GOOD_NETWORKS), "good-cdn"),
                            (_any(v, BAD_NETWORKS), "bad-cdn"), (_any(v, CLOUD_NETWORKS), "cloud")], "other")


def error_class(value: Column) -> Column:
    v = F.lower(value)
    return _ordered(value, [(v == "moved", "redirect"), (_any(v, SECURITY_ERRORS), "security"),
                            (_any(v, CONTENT_ERRORS), "content"), (_any(v, STORAGE_ERRORS), "storage")],
                    "other")


def ip_class(value: Column) -> Column:
    """Address family, single or list; anything else is bad."""
    v = F.trim(value)
    many = F.when(v.contains(","), "-multi").otherwise("")
    six = v.rlike(r"^[a-fA-F0-9:.,\s]+\z") & v.contains(":")
    four = F.regexp_replace(v, r",\s*", "").rlike(r"^[0-9.]+\z")
    return (F.when(F.coalesce(value, F.lit("")) == "", NO_CLASS).when(six, F.concat(F.lit("v6"), many))
            .when(four, F.concat(F.lit("v4"), many)).otherwise("bad"))


def user_agent_class(value: Column) -> Column:
    v = F.lower(value)
    return _ordered(value, [
        (v.contains("+http"), "good-bot"), (~v.startswith("mozilla"), "bad-bot"),
        (_any(v, ("iphone", "ipad")), "ios"), (v.contains("android"), "android"),
        (v.contains("windows"), "windows"), (_any(v, ("macintosh", "mac os")), "mac"),
        (v.contains("linux"), "linux")])


def referer_class(value: Column, own: Sequence[str] = ()) -> Column:
    v = F.lower(value)
    return _ordered(value, [(v.contains("google.com"), "google"), (_any(v, own), "own"),
                            (_any(v, (".live", ".page")), "platform")], "other")


def path_class(value: Column) -> Column:
    """Kind of resource by the extension of the last path segment."""
    path = F.lower(F.split_part(value, F.lit("?"), F.lit(1)))
    segment = F.substring_index(path, "/", -1)
    extension = F.substring_index(segment, ".", -1)
    hidden_or_none = ~F.substr(segment, F.lit(2)).contains(".")
    return _ordered(value, [(path.endswith("/"), "directory"), (hidden_or_none, "clean"),
                            *[(extension.isin(*known), kind) for kind, known in EXTENSIONS.items()]])


def encoding_class(value: Column) -> Column:
    v = F.lower(value)
    return _ordered(value, [*_contains(v, {"br": "br", "zstd": "zstd", "gzip": "gzip", "deflate": "deflate"}),
                            (v.isin("identity", "*"), "identity")])


def cache_control_class(value: Column) -> Column:
    v = F.lower(value)
    return _ordered(value, [(v.contains("no-store"), "no-store"),
                            (_any(v, ("no-cache", "max-age=0")), "no-cache"),
                            (v.contains("max-age"), "max-age")], "other")


def customer_cdn_class(value: Column) -> Column:
    return _ordered(value, _contains(F.lower(value), {k: k for k in ("fastly", "akamai", "cloudfront")}), "other")


def location_class(value: Column) -> Column:
    return _ordered(value, [(value.startswith("http://") | value.startswith("https://"), "absolute")], "relative")


def level_class(value: Column) -> Column:
    v = F.upper(value)
    return _ordered(value, [(v == "ERROR", "server-error"), (v.isin("WARN", "WARNING"), "client-error")], "ok")


def outcome_class(value: Column) -> Column:
    v = F.upper(value)
    return _ordered(value, [(v.isin("EXCEPTION", "EXCEEDED"), "server-error"),
                            (v == "CANCELED", "client-error")], "ok")


CLASSIFIERS = {
    "status": status_class, "host": host_class, "content_type": content_type_class,
    "cache_status": cache_status_class, "request_type": request_type_class,
    "backend_type": backend_type_class, "method": method_class, "network": network_class,
    "error": error_class, "ip": ip_class, "user_agent": user_agent_class, "referer": referer_class,
    "path": path_class, "accept": accept_class, "encoding": encoding_class,
    "cache_control": cache_control_class, "customer_cdn": customer_cdn_class,
    "location": location_class, "level": level_class, "outcome": outcome_class,
}
