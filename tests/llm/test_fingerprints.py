from hashlib import sha256

import numpy as np

from tidegauge.llm import fingerprints as fp


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_likeness_estimates_the_share_of_common_shingles(prose):
    errors = []
    for seed in range(40):
        a = prose(seed, 60 + 20 * seed)
        b = fp.edited(a, prose(1000 + seed, 300))
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_packing_round_trip_and_extremes(prose):
    low = fp.fingerprint(prose(1, 300))
    assert (fp.unpacked(fp.packed(low)) == low).all() and low.size == fp.BINS
    one = fp.fingerprint("a single shingle here")
    assert one.size == fp.BINS and (one == one[0]).all()
    assert fp.likeness(low, low) == 1 and fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1 and fp.likeness(low, fp.fingerprint("")) == 0
    assert fp.likeness(low, fp.fingerprint(prose(2, 300))) < 0.1


def test_every_document_meets_the_next(spark, prose):
    docs = [(i * 7 % 101, prose(i, i % 40)) for i in range(101)] + [(500, None), (501, ""), (502, "äöü" * 9)]
    frame = spark.createDataFrame([(i, t, "p", True) for i, t in docs], "doc_id long, text string, part string, ahead boolean").repartition(6)
    got = {r.doc_id: r for r in fp.edit_likeness(frame).collect()}
    assert len(got) == len(docs)
    order = sorted((i, t or "") for i, t in docs)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        new = fp.edited(t, following)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha256(new.encode()).hexdigest())
        assert got[i].fingerprint == fp.packed(fp.fingerprint(t)) and got[i].edited_fingerprint == fp.packed(fp.fingerprint(new))
        assert got[i].near_next == fp.likeness(fp.fingerprint(t), fp.fingerprint(following))


def test_repeated_ids_nulls_and_few_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z"), (2, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fp.edit_likeness(frame).collect()) == ["1", "1", "2", "None"]
    alone = fp.edit_likeness(frame.where("doc_id = 2")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert fp.edit_likeness(frame.limit(0)).collect() == [] and fp.fingerprints(frame).count() == 4
