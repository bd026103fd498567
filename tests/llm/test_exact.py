import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidegauge.llm import exact
from tidegauge.llm.exact import exact_duplicates, without_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows, keep=max):
    """Groups by the text itself: (doc_id, keep_id, group_size, sha) of every row."""
    import hashlib
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        real = [i for i in ids if i is not None]
        out.append((doc, keep(real) if real else None, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "é", "é", "long " * 50_000, "one\ntwo", "one two", "\U0001f600", "\x00"]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(100 + i, f"alone {i}") for i in range(20)]
    return rows + [(7, "twice"), (7, "twice"), (7, "other"), (None, "nobody"), (None, "nobody"), (None, "a"), (200, "hot")] + [(300 + i, "hot") for i in range(80)]


@pytest.mark.parametrize("digest, broadcast, keep", [
    (exact.content_hash, exact.BROADCAST, "largest"), (exact.content_hash, 0, "smallest"),
    (F.length, exact.BROADCAST, "smallest"), (lambda t: F.lit(0), 0, "largest")])
def test_against_brute_force(spark, monkeypatch, digest, broadcast, keep):
    """Weak hashes make every group collide; the result is that of the texts."""
    monkeypatch.setattr(exact, "BROADCAST", broadcast)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = exact_duplicates(df, keep, digest).collect()
    got = sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str)
    assert got == brute(rows, max if keep == "largest" else min)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_other_columns_empty_and_names(spark):
    rows = [(1, "x", "p", 1), (2, "x", "q", 2), (3, None, "r", 3), (3, None, "s", 4), (4, "", "t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, _id long")
    got = without_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert exact_duplicates(df.limit(0)).count() == 0
    assert without_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], StructType([StructField("doc_id", LongType()), StructField("text", StringType())]))
    assert [(r.keep_id, r.group_size) for r in exact_duplicates(nulls, "largest").collect()] == [(None, 2)] * 2
    assert sum(r.kept for r in exact_duplicates(nulls, "largest").collect()) == 1


def test_texts_without_copies_are_not_shuffled(spark, tmp_path):
    """The join that finds texts of repeated hashes is a broadcast; no exchange lies below it on the side of the texts."""
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    texts = exact._numbered(docs, exact.content_hash)
    plan = exact._colliding(texts, texts.select("hash").distinct(), 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
