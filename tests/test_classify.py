import pytest
from pyspark.sql import functions as F

from tidegauge.functions.classify import CLASSIFIERS, backend_type_class, network_class, referer_class

CASES = {
    "status": {"200": "ok", "301": "ok", "404": "client-error", "503": "server-error", "5xx": "server-error", "4xx": "client-error", "n/a": "", "": ""},
    "host": {"main--a--b.example.live": "delivery", "main--a--b.example.page": "authoring", "www.shop.com": "customer",
             "X.LIVE, other": "delivery", "www.shop.com, x.live": "customer", "": ""},
    "content_type": {"text/html": "text", "Application/JSON": "application", "image/png": "image", "video/mp4": "video",
                     "font/woff2": "font", "binary/octet-stream": "binary", "x/y": "", "": ""},
    "cache_status": {"hit": "hit", "HIT-STALE": "hit", "miss": "miss", "PASS": "pass", "pass-x": "", "dynamic": "dynamic",
                     "REVALIDATED": "revalidated", "EXPIRED": "expired", "STALE": "stale", "error-x": "error", "UNKNOWN": "unknown", "x": "", "": ""},
    "request_type": {"pipeline": "pipeline", "GitHub-Bot": "github-bot", "nothing": "", "": ""},
    "backend_type": {"Fastly / AWS": "fastly-aws", "aws": "fastly-aws", "Cloudflare / R2": "cf-r2", "cloudflare (implied)": "cf-workers", "x": "", "": ""},
    "method": {"get": "get", "POST": "post", "DELETE": "delete", "TRACE": "", "": ""},
    "network": {"54113 fastly": "good-cdn", "16509 AMAZON-02": "good-cdn", "1 zscaler": "bad-cdn", "8075 microsoft": "cloud", "2 x": "other", "": ""},
    "error": {"moved": "redirect", "Not allowed": "security", "failed to load /x from content-bus": "content", "s3: no": "storage",
              "r2: no": "storage", "else": "other", "": ""},
    "ip": {"1.2.3.4": "v4", "2001:db8::1": "v6", "1.2.3.4, 5.6.7.8": "v4-multi", "2001:db8::1, 1.2.3.4": "v6-multi", "unknown": "bad",
           "1.2.3.4, x": "bad", "": ""},
    "user_agent": {"Mozilla/5.0 (compatible; B; +http://b.example)": "good-bot", "curl/8": "bad-bot", "Mozilla/5.0 (iPhone; Mac OS X)": "ios",
                   "Mozilla/5.0 (iPad)": "ios", "Mozilla/5.0 (Linux; Android 14)": "android", "Mozilla/5.0 (Windows NT)": "windows",
                   "Mozilla/5.0 (Macintosh)": "mac", "Mozilla/5.0 (X11; Linux)": "linux", "Mozilla/5.0": "", "": ""},
    "referer": {"https://www.google.com/": "google", "https://a.example.live/": "platform", "https://a.example.page/x": "platform", "https://x.org": "other", "": ""},
    "path": {"/blog/": "directory", "/a/main.js": "script", "/style.CSS?v=1": "script", "/page.html?x=/y.png": "document", "/hero.webp": "image",
             "/v.mp4": "media", "/f.woff2": "font", "/p.php": "server", "/about": "clean", "/.well-known": "clean", "/a.b/c": "clean", "/x.zip": "", "": ""},
    "accept": {"text/html": "text", "*/*": "binary", "*/*;q=1": "", "font/x": "font", "": ""},
    "encoding": {"gzip, br": "br", "zstd": "zstd", "gzip": "gzip", "deflate": "deflate", "identity": "identity", "*": "identity", "x": "", "": ""},
    "cache_control": {"no-store, no-cache": "no-store", "no-cache": "no-cache", "max-age=0": "no-cache", "max-age=60": "max-age", "private": "other", "": ""},
    "customer_cdn": {"Fastly": "fastly", "akamai-x": "akamai", "cloudfront": "cloudfront", "x": "other", "": ""},
    "location": {"https://a/b": "absolute", "http://a": "absolute", "/b": "relative", "b": "relative", "": ""},
    "level": {"ERROR": "server-error", "warn": "client-error", "Warning": "client-error", "info": "ok", "": ""},
    "outcome": {"exception": "server-error", "exceeded": "server-error", "canceled": "client-error", "ok": "ok", "": ""},
}


@pytest.mark.parametrize("name", list(CASES))
def test_classes(spark, name):
    df = spark.createDataFrame([(v,) for v in CASES[name]], "v string")
    out = {r.v: r.c for r in df.select("v", CLASSIFIERS[name](F.col("v")).alias("c")).collect()}
    assert out == CASES[name]


def test_every_classifier_is_tested_and_takes_null(spark):
    assert set(CASES) == set(CLASSIFIERS)
    df = spark.createDataFrame([(None,)], "v string")
    out = df.select(*[f(F.col("v")).alias(n) for n, f in CLASSIFIERS.items()]).first().asDict()
    assert {v for v in out.values()} <= {"", None, "server-error"}


def test_own_names(spark):
    df = spark.createDataFrame([("1 Acme Inc",)], "v string")
    row = df.select(network_class(F.col("v"), ["acme"]), referer_class(F.lit("https://acme.com"), ["acme.com"]),
                    backend_type_class(F.lit("Cloudflare / Acme"), {"cloudflare / acme": "cf-own"})).first()
    assert row[:] == ("own", "own", "cf-own")
