"""RFC 7396 JSON merge patch as an Arrow-batched column function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_values(base, patch):
    if not isinstance(patch, dict):
        return patch
    merged = dict(base) if isinstance(base, dict) else {}
    for key, value in patch.items():
        if value is None:
            merged.pop(key, None)
        else:
            merged[key] = merge_values(merged.get(key), value)
    return merged


def _merge_texts(base: str | None, patch: str | None) -> str | None:
    try:
        merged = merge_values(json.loads(base), json.loads(patch))
    except (TypeError, ValueError):
        return patch
    return json.dumps(merged, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _merge_batch(base: pd.Series, patch: pd.Series) -> pd.Series:
    return pd.Series([_merge_texts(b, p) for b, p in zip(base, patch)], dtype=object)


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).isin("", "{}")


def merge_patch(base: Column, patch: Column) -> Column:
    """``patch`` over ``base``; '' and '{}' count as absent on either side.

    Only rows with a patch need the recursive merge. Spark evaluates a Python
    function for all rows of a batch, so the others pass NULL and cost no
    parsing.
    """
    patched = ~_blank(patch)
    onto = F.when(_blank(base), F.lit("{}")).otherwise(base)
    merged = _merge_batch(F.when(patched, onto), F.when(patched, patch))
    return F.when(patched, merged).when(~_blank(base), base).otherwise(F.lit(""))
