"""Organisation / site / profile rows from a nested configuration dump."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import EPOCH, text
from tidegauge.operators.configs import code_source_type

ENTRY = """struct<
  version: string, created: string, lastModified: string,
  code: struct<owner: string, repo: string, source: struct<type: string, url: string>>,
  content: struct<contentBusId: string, source: struct<type: string, url: string>,
                  overlay: struct<type: string, url: string>>,
  cdn: struct<prod: struct<host: string, type: string>>,
  extends: struct<profile: string>,
  folders: map<string, string>, features: string, limits: string>"""
ORG = (f"struct<config: struct<version: string, created: string, lastModified: string>, "
       f"sites: map<string, struct<data: {ENTRY}>>, profiles: map<string, struct<data: {ENTRY}>>>")
DUMP = f"map<string, {ORG}>"


@dataclass(frozen=True)
class ContentRules:
    """Where content URLs of each kind live on the platform at hand."""

    authoring_prefix: str = "https://content.authoring.example/"
    cloud_marker: str = ".cloud.example.com"
    source_prefix: str = "https://api.example.live/"


def content_type(url: Column, declared: Column, rules: ContentRules = ContentRules()) -> Column:
    """Type of a content source by its URL, else the declared one."""
    return (F.when(url.startswith(rules.authoring_prefix), "da")
            .when(url.contains(rules.cloud_marker), "xwalk")
            .when(url.startswith(rules.source_prefix), "source")
            .otherwise(declared))


def overlay_type(url: Column, declared: Column, rules: ContentRules = ContentRules()) -> Column:
    return F.when(url.contains("json2html"), "json2html").otherwise(content_type(url, declared, rules))


def _instant(column: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(column, "T", " "), "Z", "")
    return F.coalesce(F.try_to_timestamp(plain), F.lit(EPOCH).cast("timestamp"))


def _version(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0)).cast("bigint")


def read_orgs(dump: DataFrame, column: str = "orgs") -> DataFrame:
    """One row per organisation from JSON text holding the organisation map.

    A dump may be one document or, better at scale, one line per organisation:
    each text is parsed and exploded where it was read.
    """
    parsed = F.from_json(F.col(column), DUMP)
    return dump.select(F.explode(parsed).alias("org", "entry"))


def org_rows(orgs: DataFrame) -> DataFrame:
    config = F.col("entry.config")
    return orgs.filter(config.isNotNull()).select(
        "org", _version(config["version"]).alias("version"), _instant(config["created"]).alias("created"),
        _instant(config["lastModified"]).alias("last_modified"))


def _payload(rules: ContentRules) -> list[Column]:
    def field(path: str) -> Column:
        return text(F.col(f"e.data.{path}"))

    content_url, overlay_url = field("content.source.url"), field("content.overlay.url")
    code_url = field("code.source.url")
    return [
        _version(F.col("e.data.version")).alias("version"),
        _instant(F.col("e.data.created")).alias("created"),
        _instant(F.col("e.data.lastModified")).alias("last_modified"),
        field("code.owner").alias("code_owner"),
        field("code.repo").alias("code_repo"),
        code_source_type(code_url, field("code.source.type")).alias("code_source_type"),
        code_url.alias("code_source_url"),
        field("content.contentBusId").alias("content_bus_id"),
        content_type(content_url, field("content.source.type"), rules).alias("content_source_type"),
        content_url.alias("content_source_url"),
        overlay_type(overlay_url, field("content.overlay.type"), rules).alias("content_source_overlay_type"),
        overlay_url.alias("content_source_overlay_url"),
        field("cdn.prod.host").alias("cdn_prod_host"),
        field("cdn.prod.type").alias("cdn_prod_type"),
        F.coalesce(F.size("e.data.folders") > 0, F.lit(False)).alias("folders"),
        F.coalesce("e.data.features", F.lit("{}")).alias("features"),
        F.coalesce("e.data.limits", F.lit("{}")).alias("limits"),
    ]


def site_rows(orgs: DataFrame, rules: ContentRules = ContentRules()) -> DataFrame:
    entries = orgs.select("org", F.explode("entry.sites").alias("site", "e"))
    return entries.select("org", "site", text("e.data.extends.profile").alias("profile"), *_payload(rules))


def profile_rows(orgs: DataFrame, rules: ContentRules = ContentRules()) -> DataFrame:
    entries = orgs.select("org", F.explode("entry.profiles").alias("profile", "e"))
    return entries.select("org", "profile", *_payload(rules))
