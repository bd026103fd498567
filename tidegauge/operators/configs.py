"""Site and profile configurations: resolution, reports, filters, lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.json_patch import merge_patch
from tidegauge.functions.scalars import url_host
from tidegauge.operators.listing import any_column_contains
from tidegauge.operators.predicates import both

# Text settings a site inherits from its profile when its own are empty.
INHERITED_TEXT = (
    "cdn_prod_host", "cdn_prod_type", "code_owner", "code_repo", "code_source_type",
    "code_source_url", "content_bus_id", "content_source_type", "content_source_url",
    "content_source_overlay_type", "content_source_overlay_url",
)
INHERITED_JSON = ("features", "limits")
DEFAULT_PROFILE = "default"
NONE_LABEL = "(none)"

TYPE_COLUMNS = {
    "cdn": "cdn_prod_type",
    "content": "content_source_type",
    "code": "code_source_type",
    "overlay": "content_source_overlay_type",
}
PRESENCE = {
    "cdn_host": "cdn_prod_host != ''",
    "cdn_type": "cdn_prod_type != ''",
    "folders": "folders",
    "profile": "profile != ''",
    "overlay": "content_source_overlay_url != ''",
}
LIST_COLUMNS = (
    "org", "site", "version", "created_date", "cdn_prod_host", "cdn_prod_type", "code_owner",
    "code_repo", "code_source_type", "content_bus_id", "content_source_type", "content_source_url",
    "content_source_overlay_type", "content_source_overlay_url", "profile", "folders", "features",
    "limits", "last_modified_date",
)
RESOLVED_LIST_COLUMNS = (
    "org", "site", "cdn_prod_host", "cdn_prod_type", "code_owner", "code_repo", "code_source_type",
    "code_source_url", "content_bus_id", "content_source_type", "content_source_url",
    "content_source_overlay_type", "content_source_overlay_url", "folders", "features", "limits",
)

# Hosts whose code sources have their own type.
CODE_HOSTS = ("github.com", "www.github.com")


def resolve(sites: DataFrame, profiles: DataFrame) -> DataFrame:
    """Effective site settings: own value, else the profile's (latest versions in).

    A site without a profile falls back to the profile named ``default``.
    """
    wanted = F.when(F.col("s.profile") != "", F.col("s.profile")).otherwise(DEFAULT_PROFILE)
    joined = sites.alias("s").join(
        profiles.alias("p"), (F.col("s.org") == F.col("p.org")) & (F.col("p.profile") == wanted), "left")

    def inherited(c: str) -> Column:
        own = F.col(f"s.{c}")
        return F.when(own != "", own).otherwise(F.coalesce(f"p.{c}", F.lit(""))).alias(c)

    return joined.select(
        *[F.col(f"s.{c}") for c in ("org", "site", "profile", "version", "created", "last_modified")],
        *[inherited(c) for c in INHERITED_TEXT],
        (F.col("s.folders") | F.coalesce("p.folders", F.lit(False))).alias("folders"),
        *[merge_patch(F.col(f"p.{c}"), F.col(f"s.{c}")).alias(c) for c in INHERITED_JSON])


def _comparable(df: DataFrame, name: str, side: str) -> Column:
    column = F.col(f"{side}.{name}")
    if df.schema[name].dataType.typeName() == "boolean":
        return F.when(column, "true").otherwise("false")
    return F.coalesce(column.cast("string"), F.lit(""))


def compare_with_resolved(sites: DataFrame, resolved: DataFrame,
                          fields: Sequence[str] = (*INHERITED_TEXT, "folders", *INHERITED_JSON)) -> DataFrame:
    """Fields per site whose effective value is set and differs from its own."""
    joined = sites.alias("raw").join(resolved.alias("res"), ["org", "site"])

    def flag(name: str) -> Column:
        effective = _comparable(resolved, name, "res")
        differs = (effective != "") & (_comparable(sites, name, "raw") != effective)
        return F.when(differs, F.lit(name))

    return joined.select("org", "site", F.array_compact(F.array(*[flag(f) for f in fields])).alias("inherited"))


def stats(configs: DataFrame) -> DataFrame:
    """Number of sites and how many have each setting, with rounded percentages."""
    counts = configs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.expr(condition)).alias(f"with_{name}") for name, condition in PRESENCE.items()])
    pct = {f"pct_{name}": F.coalesce(F.round(F.try_divide(F.col(f"with_{name}") * 100.0, F.col("total"))), F.lit(0.0))
           .cast("bigint") for name in PRESENCE}
    return counts.withColumns(pct)


def by_type(configs: DataFrame, kind: str) -> DataFrame:
    """Sites per type of one setting, with the bar length relative to the longest."""
    column = F.col(TYPE_COLUMNS[kind])
    return (configs.groupBy(F.when(column == "", NONE_LABEL).otherwise(column).alias("type"))
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "type"))


def text_matches(text: str) -> Column:
    """``org/site`` parts, or one text in org, site, CDN host or bus id."""
    text = text.lower().strip()
    org, slash, site = text.partition("/")
    if slash:
        return F.lower("org").contains(org.strip()) & F.lower("site").contains(site.strip())
    return any_column_contains(["org", "site", "cdn_prod_host", "content_bus_id"], text)


def types_match(wanted: Mapping[str, str]) -> Column:
    """One wanted type per setting; ``(none)`` asks for the empty one."""
    return both(F.coalesce(F.col(TYPE_COLUMNS[k]), F.lit("")) == ("" if v == NONE_LABEL else v)
                for k, v in wanted.items() if v)


def presence_matches(wanted: Sequence[str]) -> Column:
    return both(F.coalesce(F.expr(PRESENCE[w]), F.lit(False)) for w in wanted)


def _listed(configs: DataFrame) -> DataFrame:
    return configs.withColumns({
        "created_date": F.date_format("created", "yyyy-MM-dd"),
        "last_modified_date": F.date_format("last_modified", "yyyy-MM-dd"),
    })


def config_list(configs: DataFrame) -> DataFrame:
    return _listed(configs).select(*LIST_COLUMNS).orderBy("org", "site")


def resolved_list(resolved: DataFrame) -> DataFrame:
    return resolved.select(*RESOLVED_LIST_COLUMNS).orderBy("org", "site")


def code_source_type(url: Column, declared: Column) -> Column:
    """Known host, any other valid URL, else what the record declares."""
    host = F.lower(url_host(url))
    known = F.when(host.isin(*CODE_HOSTS), "github").otherwise("byogit")
    return F.when((url == "") | host.isNull() | (host == ""), declared).otherwise(known)


def backfill_code_source_type(configs: DataFrame) -> DataFrame:
    """Derive the type of every row that has a URL; leave the others."""
    host = url_host(F.col("code_source_url"))
    derived = F.when(F.coalesce(host, F.lit("")).isin(*CODE_HOSTS), "github").otherwise("byogit")
    return configs.withColumn("code_source_type", F.when(
        F.col("code_source_url") != "", derived).otherwise(F.col("code_source_type")))


def add_missing_columns(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add columns the table lacks, filled with typed defaults; keep existing ones."""
    new = {name: F.lit(value).cast(kind) for name, (kind, value) in defaults.items() if name not in df.columns}
    return df.withColumns(new) if new else df


# The payload columns profiles gained later.
PROFILE_PAYLOAD = {
    **{c: ("string", "") for c in (*INHERITED_TEXT, *INHERITED_JSON)},
    "folders": ("boolean", False),
}
