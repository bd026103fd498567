import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top, longest=5):
    """The contract word by word, on lists of words."""
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                inside.update(p[i:i + k] for i in range(len(p) - k + 1) if 100 * a >= 100 * candidates[p[i:i + k]])
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "é", "É", "x\x00", "日本", "of the", "I.", "zz", "\U0001f600"]
    fixed = ["a b c d e f", "of the zz", "New York, new york", "a a a a a a a", "b\tb  b", "one\ntwo\x0bthree"]
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 30))]
        yield i // 2, rng.choice([" ", "  ", "; "]).join(parts), rng.choice(["en", "en", "fr", None, "", "und"])


@pytest.mark.parametrize("block, broadcast", [(c.BLOCK, 0), (7, c.BROADCAST), (7, 0)])
def test_against_brute_force(spark, monkeypatch, block, broadcast):
    """Whole blocks, and blocks shorter than texts and nearly as short as phrases, with either way of the semi-join."""
    monkeypatch.setattr(c, "BLOCK", block)
    monkeypatch.setattr(c, "BROADCAST", broadcast)
    rows = [*texts(1, 150), (None, None, "en"), (9, "", "de"), (10, "a b c d e " * 300, "fr"), (10, "a b c d e " * 300, "fr")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = c.collocations(df, least=5, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 40)


def test_no_lists_of_candidates_are_collected_and_pairs_are_shuffled_as_one_number(spark, monkeypatch):
    """With more frequent phrases than are broadcast, a block's candidates come by co-group, not as a list in an aggregate."""
    plans, real = [], c.written

    def recorded(df, purpose, *more):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, purpose, *more)
    monkeypatch.setattr(c, "written", recorded)
    monkeypatch.setattr(c, "BROADCAST", 0)
    rows = list(texts(3, 60))
    assert sorted(tuple(r) for r in c.collocations(spark.createDataFrame(rows, SCHEMA), longest=3, least=4, top=10).collect()) == brute(rows, 4, 10, longest=3)
    assert not any("collect_list" in plan for _, plan in plans)
    pairs = [plan for purpose, plan in plans if purpose == "frequent"][1:]
    assert len(pairs) == 2 and all("keys=[pair" in plan or "keys=[_groupingexpression" in plan for plan in pairs)


@pytest.mark.parametrize("numbers, tasks", [(1, 4), (2, 200), (70_000, 51), ((1 << 31) - 1, 1), ((1 << 31) - 1, 10_000)])
def test_dealt_pairs_come_back(numbers, tasks):
    """Smallest and largest numbers, counts of one and of several digits."""
    rng = np.random.default_rng(5)
    a, b = np.append(rng.integers(0, numbers, 500), [0, numbers - 1]), np.append(rng.integers(0, numbers, 500), [numbers - 1, numbers - 1])
    mix = c._Mixed(numbers, tasks)
    mixed = np.unique(mix.mixed(a, b))
    counts = np.where(np.arange(mixed.size) % 3, 1, rng.integers(1, 1 << 40, mixed.size))
    back = Counter()
    for batch in c._lists_of(mix, mixed, counts):
        assert batch.schema.equals(c._arrow(c.DEALT))
        for row in pa.Table.from_batches([batch]).to_pylist():
            for high, low, n in zip(row["high"], row["low"], row["n"], strict=True):
                back[row["bucket"] << mix.rest | high << 16 | low & 0xFFFF] += n << row["shift"]
    assert back == dict(zip(mixed.tolist(), counts.tolist(), strict=True))
    assert set(zip(*(x.tolist() for x in mix.pairs(mixed)), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_pairs_are_shuffled_as_lists_of_their_lower_bits(spark, monkeypatch):
    """Pairs that many blocks share leave a task once; a list takes three bytes and a count's seven bits a pair."""
    rng = random.Random(7)
    data = [(sorted({(rng.randrange(70_000), rng.randrange(9)) for _ in range(4000)}), rng.randint(1, 300)) for _ in range(6)] * 3
    blocks = spark.createDataFrame([([a for a, _ in pairs], [b for _, b in pairs], [n] * len(pairs)) for pairs, n in data], "a array<long>, b array<long>, n array<int>")
    brute_force = Counter()
    for pairs, n in data:
        brute_force.update(dict.fromkeys(pairs, n))
    rows = c._dealt(blocks.coalesce(1), c._Mixed(70_000, 4)).where("shift = 0").agg(F.sum(F.size("low")).alias("pairs"), F.count("*").alias("lists")).first()
    assert rows["pairs"] <= len(brute_force) and 50 * rows["lists"] < rows["pairs"]
    for most in (c.SUMMED, 5000):
        monkeypatch.setattr(c, "SUMMED", most)
        got = c._counted_pairs(blocks.repartition(3), 400, 70_000)
        assert {(r["a"], r["b"]): r["f"] for r in got.collect()} == {p: n for p, n in brute_force.items() if n >= 400}


def test_shorter_phrases_empty_and_other_columns(spark):
    rows = list(texts(2, 40))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, block string")
    assert sorted(tuple(r) for r in c.collocations(df, longest=3, least=4, top=10).collect()) == brute(rows, 4, 10, longest=3)
    assert c.collocations(df.limit(0)).count() == 0
    assert c.collocations(spark.createDataFrame([(1, None, None), (2, " .", "x")], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r of counts as large as a corpus of 10**15 words has them."""
    row = spark.sql("SELECT (1000BD * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s "
                    "FROM VALUES (700000000001L, 1000000000000007L, 900000000003L, 800000000009L) AS t(a, n, l, r)").first()
    assert row.s == 1000 * 700000000001 * 1000000000000007 // (900000000003 * 800000000009)
