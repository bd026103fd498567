import random

from tidegauge.llm.decontaminate import contaminated, without_contaminated


def brute(docs, items):
    def runs(text, width):
        w = (text or "").lower().split()
        return {" ".join(w[i:i + width]) for i in range(len(w) - width + 1)}
    out = {}
    for item, question in items:
        n = len((question or "").split())
        asked = runs(question, min(5, n)) if n else set()
        for doc, text in docs:
            if asked and (share := len(asked & runs(text, min(5, n))) / len(asked)) >= 0.8:
                out[doc, item] = max(share, out.get((doc, item), 0))
    return out


def test_finds_what_brute_force_finds(spark, prose):
    rng = random.Random(4)
    items = [(i, prose(100 + i, n)) for i, n in enumerate([3, 4, 5, 6, 12, 15, 16, 20, 25, 33, 37, 60, 130])] + [(50, None), (51, " "), (52, prose(104, 12))]
    docs = [(i, prose(i, rng.choice([0, 3, 50, 400, 3000]))) for i in range(60)]
    for k, (_, question) in enumerate(items[:13]):
        at, body = rng.randint(0, 40), prose(200 + k, 900).split()
        cut = question.split()
        docs.append((100 + k, " ".join(body[:at] + cut + body[at:])))
        docs.append((200 + k, " ".join(body[:at] + cut[:len(cut) // 2] + body[at:])))  # half of it is not enough
        docs.append((300 + k, " ".join(body + cut).upper()))
    docs += [(None, "x " + items[8][1]), (400, None), (401, ""), (402, items[9][1] + " " + items[10][1]), (402, items[9][1])]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, key string, item_id int").repartition(5)
    bench = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, shingles string")
    got = {(r.doc_id, r.item_id): r.containment for r in contaminated(frame, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 30
    kept = without_contaminated(frame, bench)
    assert kept.columns == frame.columns
    bad = {d for d, _ in want}
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, _ in docs if d not in bad)


def test_short_items_are_all_found(spark, prose):
    """Items of one, two and three shingles (and shorter than one) at the start, inside and at the end of a document each."""
    rng, items, docs = random.Random(6), [], []
    for i in range(400):
        words = [f"q{rng.randrange(10 ** 6)}" for _ in range((5, 6, 7, 3)[i % 4])]
        body = prose(i, 120).split()
        items.append((i, " ".join(words)))
        docs += [(3 * i + k, " ".join(body[:at] + words + body[at:])) for k, at in enumerate((0, 50, 120))]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                                                       spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(3 * i + k, i) for i in range(400) for k in range(3)}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(docs, bench.limit(0)).collect() == [] == contaminated(docs.limit(0), bench).collect()
    assert without_contaminated(docs, bench.limit(0)).count() == 1


def test_few_candidates_leave_texts_in_place(spark, prose, tmp_path):
    """Ids of few candidates are broadcast: no exchange deals texts out by document."""
    spark.createDataFrame([(i, prose(i, 60)) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, bench = spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame([(1, prose(7, 60))], "item_id long, text string")
    for df, ids in ((contaminated(docs, bench), [7]), (without_contaminated(docs, bench), [i for i in range(50) if i != 7])):
        assert sorted(r.doc_id for r in df.collect()) == ids
        assert "hashpartitioning(coalesce(doc_id" not in df._jdf.queryExecution().executedPlan().toString()
