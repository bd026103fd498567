"""Inventory of customer domains seen in front of the delivery hosts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import days_crossed, first_item, hours_crossed
from tidegauge.operators.listing import any_column_contains, ordered
from tidegauge.operators.predicates import both, newer_than

# Forwarded hosts that are no customer domain, as LIKE patterns.
UNWANTED_FORWARDED = ("localhost%", "%.workers.dev%", "%<%", "%{%", "%/%", "%oast%")
# Numeric hosts, and what a domain name looks like.
NUMERIC_HOST = "^[0-9.]+\\z"
DOMAIN_NAME = "^[a-z0-9][a-z0-9.-]+\\.[a-z]{2,}\\z"
REPORT_AGE = timedelta(days=7)
NEW_DOMAIN_DAYS = 1


@dataclass(frozen=True)
class Platform:
    """The names a platform operator uses for its own hosts."""

    live_suffix: str = ".example.live"
    preview_suffix: str = ".example.page"
    review_suffix: str = ".example.reviews"
    own_domains: tuple[str, ...] = ("example.live",)


def customer_traffic(platform: Platform) -> Column:
    """Requests to a live host that came through another, well-formed host."""
    host, forwarded = F.col("request_host"), F.col("request_headers_x_forwarded_host")
    return both([
        host.like(f"%{platform.live_suffix}"),
        forwarded != "", forwarded != host,
        ~forwarded.like(f"%{platform.preview_suffix}"),
        *[~forwarded.like(p) for p in UNWANTED_FORWARDED],
    ])


def forwarded_domain(column: str) -> Column:
    """First host of the list, without port and trailing dots, in lower case."""
    first = F.trim(first_item(F.col(column), ","))
    return F.lower(F.rtrim(first_item(first, ":"), F.lit(".")))


def is_customer_domain(domain: Column, platform: Platform) -> Column:
    """A domain name that is neither an address nor the platform's own."""
    return (~domain.rlike(NUMERIC_HOST) & ~domain.isin(*platform.own_domains)
            & ~domain.like(f"%{platform.review_suffix}") & domain.rlike(DOMAIN_NAME))


def domain_report(df: DataFrame, platform: Platform, as_of: datetime, age: timedelta = REPORT_AGE,
                  time: str = "timestamp", day: str | None = None) -> DataFrame:
    """Domain, owner, repo and CDN type with request rate, total and age.

    Rows count one each. They are first grouped by the raw header values, so
    names are taken apart per group, not per row. The conditions on the domain
    travel as an aggregate: as plain predicates on a group key they would be
    pushed below both aggregations and evaluated for every row again.
    """
    host = F.col("request_host")
    # The suffix is cut where it occurs first; the host ends with it.
    at = F.instr(host, platform.live_suffix)
    site = F.concat(F.substring(host, F.lit(1), at - 1),
                    F.substring(host, at + len(platform.live_suffix), F.length(host)))
    raw = df.filter(customer_traffic(platform) & newer_than(df, age, as_of, time, day)).groupBy(
        "request_host", "request_headers_x_forwarded_host", "request_headers_x_byo_cdn_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    named = raw.select(
        forwarded_domain("request_headers_x_forwarded_host").alias("domain"),
        F.split_part(site, F.lit("--"), F.lit(3)).alias("owner"),
        F.split_part(site, F.lit("--"), F.lit(2)).alias("repo"),
        F.col("request_headers_x_byo_cdn_type").alias("cdn_type"), "n", "first", "last")
    groups = named.groupBy("domain", "owner", "repo", "cdn_type").agg(
        F.sum("n").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max(is_customer_domain(F.col("domain"), platform)).alias("wanted")).filter("wanted")
    now = F.lit(as_of.isoformat(sep=" ")).cast(df.schema[time].dataType)
    hours = hours_crossed(F.col("first"), F.col("last")) + 1
    return groups.select(
        "domain", "owner", "repo", "cdn_type",
        F.round(F.col("total") / hours, 1).alias("req_per_hour"),
        "total", days_crossed(F.col("first"), now).alias("age_days"))


def domain_listing(report: DataFrame, sort: str = "total", ascending: bool = False,
                   text: str = "") -> DataFrame:
    """The report as listed: text filter, any sort column, new-domain mark."""
    rows = report.filter(any_column_contains(["domain", "owner", "repo"], text))
    rows = rows.withColumn("is_new", F.col("age_days") <= NEW_DOMAIN_DAYS)
    return ordered(rows, sort, ascending, [F.col("total").desc(), "domain", "owner", "repo", "cdn_type"])
