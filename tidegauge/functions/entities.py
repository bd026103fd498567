"""Entities found in free log text, and its JSON reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity -> pattern. Word boundaries of the address pattern are
# spelled out for ASCII, as Java's \b also knows accented letters.
ENTITY_PATTERNS = {
    "urls": r"""https?://[^\s'"}>\\]+""",
    "paths": r"/[a-zA-Z0-9._%-]+(?:/[a-zA-Z0-9._%-]+)+",
    "hostnames": r"[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "emails": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "ips": r"(?<![a-zA-Z0-9_])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![a-zA-Z0-9_])",
    "refs": r"[a-zA-Z0-9_-]+--[a-zA-Z0-9_-]+--[a-zA-Z0-9_-]+",
}


def find_all(message: Column | str, entity: str) -> Column:
    column = F.col(message) if isinstance(message, str) else message
    return F.regexp_extract_all(column, F.lit(ENTITY_PATTERNS[entity]), F.lit(0))


def message_variant(message: Column | str) -> Column:
    """The message as JSON; text that is none becomes an empty object."""
    return F.coalesce(F.try_parse_json(message), F.parse_json(F.lit("{}")))


def with_entities(df: DataFrame, message: str = "message") -> DataFrame:
    """App log lines with ``message_json`` and one array per entity."""
    text = F.coalesce(F.col(message), F.lit(""))
    return df.withColumns({
        "message_json": message_variant(message),
        **{entity: find_all(text, entity) for entity in ENTITY_PATTERNS},
    })
