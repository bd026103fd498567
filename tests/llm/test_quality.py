import numpy as np
import pytest

from tidegauge.llm import quality
from tidegauge.llm.common import table


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    return docs, labels, quality.fit(docs, labels)


def test_held_out_accuracy(spark, fitted):
    """The learned words come from the labels; their part here is the quality, which no labeller has seen."""
    docs, labels, judge = fitted
    out = quality.scored(docs, judge).join(labels, "doc_id").collect()
    broken = [(r.broken >= 0.5) == (r.quality == 0) for r in out]
    assert np.mean(broken) > 0.97
    english = docs.where("lang = 'en'").select("doc_id").join(labels, "doc_id").collect()
    toxic = {r.doc_id for r in english if r.toxic}
    found = {r.doc_id for r in out if r.abusive >= 0.5}
    clean = {r.doc_id for r in out if r.toxic == 0}
    assert len(toxic & found) >= 0.9 * len(toxic) and len(clean & found) <= 0.02 * len(clean)


@pytest.mark.parametrize("against", [0, -1])
@pytest.mark.parametrize("false, true", [((0.05, 0.10, 0.02, 0.20), (0.8, 0.7, 0.9, 0.6)), ((0.01, 0.3, 0.1, 0.05, 0.2), (0.5, 0.7, 0.6, 0.8, 0.4))])
def test_expectation_maximisation_recovers_rates(false, true, against):
    """Independent labellers whose false votes are anything but rare; no label is given. Better than any single vote, and than a majority."""
    rng = np.random.default_rng(1)
    bad = rng.random(40_000) < 0.3
    votes = np.stack([np.where(rng.random(bad.size) < np.where(bad, t, f), 1, against) for f, t in zip(false, true, strict=True)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.3) < 0.05
    assert np.abs(model.table[:, 2, 0] - false).max() < 0.05 and np.abs(model.table[:, 2, 1] - true).max() < 0.05
    right = ((model.posterior(votes) > 0.5) == bad).mean()
    assert right > ((votes > 0).any(axis=1) == bad).mean() + 0.1 and right > (((votes > 0).sum(axis=1) >= 2) == bad).mean() + 0.005


def test_stems_must_be_frequent_and_sure():
    counted = [("rare", 3, 0), ("sure", 20, 0), ("surely", 15, 0), ("both", 20, 10), ("good", 0, 50)]
    assert quality.learned_stems(counted, 40, 200) == {"sure"}


def test_defined_cases(spark, fitted):
    _, labels, judge = fitted
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A plain sentence about nothing in particular."), (4, "A plain sentence about nothing in particular."), (None, "AAA!! BBB!! CCC!! " * 20),
            (6, " ".join(f"{w} " * 300 for w in "thing other matter place people number year way day part".split() * 20))]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, broken double")
    out = quality.scored(docs, judge).collect()
    assert sorted((str(r.doc_id), r.keep) for r in out) == sorted([("1", False), ("2", False), ("3", False), ("4", True), ("4", True), ("None", False), ("6", False)])
    assert quality.kept(docs, judge).columns == docs.columns and quality.kept(docs, judge).count() == 2
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.scored(docs.limit(0), empty).collect() == [] and quality.scored(docs, empty).count() == len(rows)
    assert quality.scored(docs, quality.fit(docs, labels.limit(0))).count() == len(rows)
