import random

import numpy as np

from tidegauge.llm import repeats


def brute(docs, n=repeats.MIN_WORDS):
    seen = {}
    for doc, text in docs:
        w = (text or "").split()
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i:i + n]), set()).add(doc)
    out = {}
    for doc, text in docs:
        w = (text or "").split()
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i:i + n])]) > 1:
                out.setdefault(doc, set()).update(range(i, i + n))
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_spans_are_those_of_brute_force(spark, prose):
    rng = random.Random(2)
    docs = [(i, prose(i, rng.choice([0, 10, 60, 300, 900]))) for i in range(40)]
    passages = [prose(500 + k, n) for k, n in enumerate([49, 50, 51, 60, 90, 200])]
    for k in range(60):
        a, b = prose(2000 + k, rng.randint(0, 120)), prose(3000 + k, rng.randint(0, 120))
        docs.append((100 + k, f"{a} {passages[k % 6]} \n{b}"))
    docs += [(300 + k, docs[5][1] if k else docs[7][1]) for k in range(5)] + [(400, prose(9, 70) * 3), (401, None), (402, "")]
    frame = spark.createDataFrame([(i, t, "f", "k") for i, t in docs], "doc_id long, text string, first string, key string").repartition(5)
    spans = repeats.repeated_spans(frame).collect()
    assert covered(spans) == brute(docs)
    kept = repeats.without_repeats(frame, repeats.repeated_spans(frame))
    assert kept.columns == frame.columns and kept.count() == len(docs)
    cut = {r.doc_id: (r.text or "").split() for r in kept.collect()}
    first = min(d for d, t in docs if t and passages[5] in t.replace(" \n", " "))
    assert passages[5] in " ".join(cut[first]) and sum(passages[5] in " ".join(w) for w in cut.values()) == 1


def test_partner_among_crowds_that_share_one_side_as_well(spark):
    """Two documents share A + B + C of 50 words; many others A + B or B + C only, and the keys lie in B."""
    rng, docs, found = random.Random(7), [], 0

    def other(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    while found < 8:
        passage = other(50)
        places = repeats.minimisers(repeats.word_hashes(" ".join(other(60) + passage + other(60)))) - 60
        inside = [p for p in places if 0 <= p and p + repeats.SURE <= 50]
        if not inside or any(p < 10 or p + repeats.SURE > 40 for p in inside):
            continue
        found += 1
        for part in [passage] * 2 + [passage[:40]] * 25 + [passage[10:]] * 25:
            docs.append((len(docs), " ".join(other(60) + part + other(60))))
    want = brute(docs)
    assert len(want) == 16
    assert covered(repeats.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()) == want


def test_equal_contexts_over_many_partitions(spark, prose):
    passage = prose(1, 100)
    docs = [(1, " ".join([passage] * 150)), (2, prose(2, 80) + " " + passage + " " + prose(3, 80)), (3, passage), (4, prose(4, 200))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        spans = repeats.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert covered(spans) == brute(docs)


def test_minimisers_agree_in_equal_passages(prose):
    passage = prose(1, 80).split()
    places = []
    for k in range(6):
        before = prose(50 + k, 13 * k).split() if k else []
        at = repeats.minimisers(repeats.word_hashes(" ".join(before + passage + prose(90 + k, 40).split()))) - len(before)
        places.append(set(at[(at >= repeats.WINDOW) & (at < 80 - 2 * repeats.WINDOW)]))
    assert all(p == places[0] for p in places)


def test_gram_hashes_depend_on_every_word():
    words = np.arange(1, 40, dtype=np.uint64)
    for width in (8, 19):
        base = repeats.grams(words, width)
        for j in range(width):
            other = words.copy()
            other[j] += np.uint64(1)
            assert repeats.grams(other, width)[0] != base[0]


def test_defined_cases(spark, prose):
    text = prose(3, 70)
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (1, text), (2, "short"), (3, None)], "doc_id long, text string")
    assert repeats.repeated_spans(docs).collect() == []
    assert repeats.repeated_spans(docs.limit(0)).collect() == []
    assert repeats.cut("a b  c d", [{"start_word": 1, "end_word": 3}]) == "a d" and repeats.cut(None, None) is None


def test_chunks_do_not_change_matches(spark, prose, monkeypatch):
    """The suffix array compared a few rows at a time gives the spans of whole ranges, blocks longer than a chunk included."""
    passage, other = prose(900, 70), prose(901, 55)
    docs = [(i, f"{prose(i, 40)} {passage} {prose(50 + i, 30)} {other if i % 2 else ''}") for i in range(12)] + [(20, " ".join([passage] * 9)), (21, f"{passage} {passage}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = covered(repeats.repeated_spans(frame).collect())
    for chunk in (1, 5):
        compare = repeats._compare

        def small(side, chunk=chunk, compare=compare):
            run = compare(side)

            def with_chunk(batches):
                from tidegauge.llm import repeats as module
                module.CHUNK = chunk
                one_by_one = (b.slice(i, 2) for b in batches for i in range(0, b.num_rows, 2))
                return run(one_by_one)
            return with_chunk
        monkeypatch.setattr(repeats, "_compare", small)
        assert covered(repeats.repeated_spans(frame).collect()) == want
        monkeypatch.setattr(repeats, "_compare", compare)
    assert want == brute(docs)


def test_cutting_keeps_clashing_columns(spark, prose):
    passage = prose(902, 60)
    frame = spark.createDataFrame([(1, passage, 5, "s", "a"), (2, f"x {passage} y", 6, "t", "b")], "doc_id long, text string, _id int, _spans string, __id string")
    kept = repeats.without_repeats(frame, repeats.repeated_spans(frame))
    assert kept.columns == frame.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, passage, 5, "s", "a"), (2, "x y", 6, "t", "b")]
