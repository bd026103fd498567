"""Quality classifier from weak labels: no document needs a label by hand.

Overlapping heuristic labellers vote on each document, for, against or not at
all, about two properties: whether its text is broken and whether it is abusive.
Expectation-maximisation estimates from the agreement of the votes how accurate
each labeller is and how likely each combination of votes belongs to a bad
document. It works on the counts of vote combinations over all documents, a
table whose size is fixed by the number of labellers.

The labellers of abuse know a word list that is learned: beginnings of words that
a bounded sample of rows of the ``labels`` table shows almost only in abusive
documents. Abuse in a language nobody wrote a list for is found that way.

The posterior labels then train a logistic scorer over hashed features of the
whole text on a bounded sample, and that scorer judges every document.

Defined cases: NULL, empty and blank texts have no features and are rejected as
broken; equal texts get equal scores; rows that repeat an id are judged each on
their own; labels that are NULL count as good; without labels the learned list is
empty and its labellers abstain; an empty table gives no rows; a corpus without a single bad (or good)
vote combination is judged by the posterior of the votes alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches, written

#: Hashed features of the scorer.
DIMENSIONS = 1 << 16
#: Documents the scorer is fitted on, at most; chosen by a hash of the text.
SAMPLE = 12_000
#: Labelled rows the word beginnings are learned from, at most; chosen by a hash of the id.
LABELLED = 8_000
#: Lengths of the beginnings, documents one must be in, and how many are kept.
BEGINNINGS, SEEN, STEMS = (4, 5, 6, 8), 8, 256
#: A document is rejected from this probability of being bad.
REJECT = 0.5
#: Where the estimation starts: chances of the votes good, none, bad on good and on bad documents, the
#: share of bad documents, and how many documents this counts as.
BELIEVED, BAD_SHARE, WEIGHT = ((0.38, 0.1), (0.6, 0.6), (0.02, 0.3)), 0.1, 2.0
#: Votes: 1 bad, -1 good, 0 abstains.
LABELLERS = {
    "broken": ("symbols", "capitals", "repeats", "cells", "blank", "letters", "variety", "common"),
    "abusive": ("stems", "rate", "kinds"),
}
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[^\w\s.,;:'\"()\-+=@/]")


def features(text: str | None, stems: frozenset[str] = frozenset()) -> tuple[dict[str, float], Counter[str]]:
    """Shares a labeller looks at, over the whole text, and the counts of its words in lower case."""
    text = text or ""
    pieces, found = text.split(), WORD.findall(text)
    letters = sum(map(len, found))
    counts = Counter(map(str.lower, found))
    n = max(len(pieces), 1)
    stemmed = [c for w, c in counts.items() if w[:4] in stems or w[:5] in stems or w[:6] in stems or w[:8] in stems] if stems else []
    return {
        "pieces": len(pieces), "marked": sum(1 for p in pieces if MARKS.search(p)) / n, "cells": pieces.count("|") / n,
        "capitals": sum(map(len, (w for w in found if w.isupper() and len(w) > 1))) / max(letters, 1),
        "repeats": sum(map(eq, pieces, pieces[1:])) / n, "variety": len(counts) / max(len(found), 1),
        "common": max(counts.values(), default=0) / max(len(found), 1), "letters": letters / max(sum(map(len, pieces)), 1),
        "stemmed": sum(stemmed), "kinds": len(stemmed), "stems": len(stems)}, counts


def _vote(bad: bool, good: bool) -> int:
    return 1 if bad else -1 if good else 0


def votes(f: dict[str, float]) -> dict[str, list[int]]:
    """Votes of the labellers, in the order of ``LABELLERS``."""
    known, long, learned = f["pieces"] > 0, f["pieces"] > 20, f["stems"] > 0
    plain = known and f["marked"] < 0.03 and f["capitals"] < 0.03 and f["repeats"] < 0.05 and f["cells"] < 0.02
    return {
        "broken": [
            _vote(f["marked"] > 0.08, False), _vote(f["capitals"] > 0.1, False), _vote(f["repeats"] > 0.1, False), _vote(f["cells"] > 0.05, False),
            _vote(not known, False), _vote(f["letters"] < 0.6 and long, plain and f["letters"] > 0.9),
            _vote(f["variety"] < 0.02 and long, plain and f["variety"] > 0.3), _vote(f["common"] > 0.6 and long, plain and f["common"] < 0.15)],
        "abusive": [
            _vote(f["stemmed"] > max(1, 0.003 * f["pieces"]) or f["stemmed"] > 0.02 * f["pieces"], f["stemmed"] == 0 and learned and known),
            _vote(f["stemmed"] / max(f["pieces"], 1) > 0.003, f["stemmed"] == 0 and learned), _vote(f["kinds"] > 1, f["kinds"] == 0 and learned)],
    }


@dataclass
class LabelModel:
    """``table[t][v]``: how likely labeller t casts vote v - 1 on a good (column 0) and a bad (column 1) document."""
    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being bad for each row of votes."""
        logs = np.log([1 - self.prior, self.prior]) + np.log(self.table[np.arange(patterns.shape[1]), patterns + 1]).sum(axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over vote combinations and their counts.

    Most labellers know one kind of fault and abstain otherwise, so abstaining
    is a vote with chances of its own. Both classes start from ``BELIEVED``
    chances, by which votes for bad speak for the bad class, and these count as
    ``WEIGHT`` documents in each round: a start that tells the classes apart and
    keeps chances off zero, not a bound on what the votes can teach.
    """
    believed = np.repeat(np.asarray(BELIEVED)[None], patterns.shape[1], axis=0)
    model = LabelModel(BAD_SHARE, believed)
    bad = model.posterior(patterns)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - bad), counts * bad], axis=1)
        prior = float((weight[:, 1].sum() + WEIGHT * BAD_SHARE) / (weight.sum() + WEIGHT))
        table = np.stack([[weight[patterns[:, t] == v].sum(axis=0) for v in (-1, 0, 1)] for t in range(patterns.shape[1])]) + WEIGHT * believed
        model = LabelModel(prior, table / table.sum(axis=1, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - bad).max(initial=0) < 1e-6:
            break
        bad = new
    return model


def hashed(f: dict[str, float], counts: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features: its words by frequency, and the shares in steps."""
    total = max(sum(counts.values()), 1)
    index = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % DIMENSIONS for w in counts]
    value = [min(0.1, 2 * c / total) for c in counts.values()]
    for name in ("marked", "capitals", "repeats", "cells", "letters", "variety", "common", "kinds"):
        steps = min(int(f[name]), 5) if name == "kinds" else int(min(f[name], 1) * 20)
        index += [zlib.crc32(f"{name}>={i}".encode()) % DIMENSIONS for i in range(steps + 1)]
        value += [0.3] * (steps + 1)
    return np.asarray(index, np.int64), np.asarray(value)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 12, rate: float = 0.5, keep: float = 1e-6) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer; adaptive steps, soft labels, balanced classes."""
    weights, squares = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    balance = np.where(labels > 0.5, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)).clip(0.2, 20)
    lengths = np.asarray([r[0].size for r in rows])
    order = np.arange(len(rows))
    for turn in range(rounds):
        order = np.random.default_rng(turn).permutation(len(rows))
        for at in range(0, order.size, 64):
            some = order[at:at + 64]
            index, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            owner = np.repeat(np.arange(some.size), lengths[some])
            score = np.bincount(owner, weights[index] * value, minlength=some.size) + weights[-1]
            error = (1 / (1 + np.exp(-score.clip(-30, 30))) - labels[some]) * balance[some] / some.size
            used, place = np.unique(index, return_inverse=True)
            slope = np.bincount(place, error[owner] * value, minlength=used.size) + keep * weights[used]
            squares[used] += slope ** 2
            weights[used] -= rate * slope / np.sqrt(squares[used])
            squares[-1] += error.sum() ** 2
            weights[-1] -= rate * error.sum() / np.sqrt(squares[-1])
    return weights


def learned_stems(counted: list[tuple[str, int, int]], bad: int, good: int) -> frozenset[str]:
    """Beginnings (with the bad and good documents they are in) that mark bad documents and hardly ever good ones."""
    def sure(n_bad: int, n_good: int) -> bool:
        return n_bad >= SEEN and n_bad / max(bad, 1) > 50 * n_good / max(good, 1)
    found = sorted(((-n_bad, stem) for stem, n_bad, n_good in counted if sure(n_bad, n_good)), key=lambda x: (x[0], len(x[1]), x[1]))
    stems: list[str] = []
    for _, stem in found:
        if not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    return frozenset(stems[:STEMS])


@dataclass
class Classifier:
    """Learned beginnings; label models and scorers by property."""
    stems: frozenset[str]
    models: dict[str, LabelModel]
    scorers: dict[str, np.ndarray | None]

    def scores(self, text: str | None) -> tuple[float, float]:
        """Probabilities of being broken and of being abusive."""
        f, counts = features(text, self.stems)
        if not f["pieces"]:
            return 1.0, 0.0
        index, value = hashed(f, counts)
        out = []
        for name, model in self.models.items():
            weights = self.scorers[name]
            if weights is None:
                out.append(float(model.posterior(np.asarray([votes(f)[name]]))[0]))
            else:
                out.append(float(1 / (1 + np.exp(-np.clip(weights[index] @ value + weights[-1], -30, 30)))))
        return out[0], out[1]


def stems_of(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> frozenset[str]:
    """Learns word beginnings from at most ``labelled`` rows of ``labels`` (``doc_id``, ``toxic``)."""
    chosen = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
              .agg(F.coalesce(F.max(F.col("toxic").cast("int")), F.lit(0)).alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(labelled))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[bool, Counter[str]] = {False: Counter(), True: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(map(str.lower, WORD.findall(text or "")))
                counts[toxic > 0].update({w[:k] for w in found for k in BEGINNINGS if len(w) >= k} | {""})
            keys = list(counts[True].keys() | counts[False].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([counts[b][k] for k in keys], pa.int64()) for b in (True, False))], ["stem", "bad", "good"])
        return one
    counted = map_batches(rows.select("text", "toxic"), "stem string, bad long, good long", make).groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # The empty beginning counts the documents. What is rarer among bad documents than SEEN stays behind; the rest is bounded by the sample.
    found = [tuple(r) for r in counted.where(f"stem = '' OR bad >= {SEEN} AND bad > 5 * good").collect()]
    bad, good = next(((b, g) for stem, b, g in found if stem == ""), (0, 0))
    return learned_stems([r for r in found if r[0]], bad, good)


def _votes(docs: DataFrame, stems: frozenset[str]) -> DataFrame:
    """Votes of every document (``broken``, ``abusive``) with a hash that orders the sample."""
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [votes(features(t, stems)[0]) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([_bytes([v[n] for v in found]) for n in LABELLERS] + [batch.column(1)], [*LABELLERS, "at"])
        return one
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("at"))
    return map_batches(rows, "broken array<tinyint>, abusive array<tinyint>, at long", make)


def _bytes(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int8()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, labelled: int = LABELLED) -> Classifier:
    """Label models from the votes on all documents; scorers from at most ``sample`` of them.

    The sample takes the documents with the smallest text hashes, repeated texts
    once; only its hashed features, not its texts, reach the driver.
    """
    stems = stems_of(docs, labels, labelled)
    cast = written(_votes(docs, stems), "votes")
    models = {}
    for name in LABELLERS:
        counts = cast.groupBy(name).agg(F.count("*").alias("n")).collect()  # at most 3 to the number of labellers
        patterns = np.asarray([r[name] for r in counts], np.int64).reshape(-1, len(LABELLERS[name]))
        models[name] = fit_labels(patterns, np.asarray([r["n"] for r in counts], float))
    last = cast.select("at").distinct().orderBy("at").limit(sample).agg(F.max("at")).first()[0]
    if last is None:
        return Classifier(stems, models, dict.fromkeys(LABELLERS))
    rows = docs.where(F.xxhash64("text") <= last).select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("at")).dropDuplicates(["at"])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t, stems) for t in batch.column(0).to_pylist()]
            both, cast = [hashed(f, c) for f, c in found], [votes(f) for f, _ in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([b[0].astype(np.int32) for b in both], pa.list_(pa.int32())), pa.array([b[1].astype(np.float32) for b in both], pa.list_(pa.float32()))]
                + [_bytes([v[n] for v in cast]) for n in LABELLERS], ["index", "value", *LABELLERS])
        return one
    taken = map_batches(rows, "index array<int>, value array<float>, broken array<tinyint>, abusive array<tinyint>", make).toArrow()
    sparse = [(i.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(float)) for i, v in zip(taken["index"], taken["value"], strict=True)]
    scorers: dict[str, np.ndarray | None] = {}
    for name, model in models.items():
        labels_ = model.posterior(np.asarray(taken[name].to_pylist(), np.int64).reshape(len(sparse), len(LABELLERS[name])))
        both = (labels_ > 0.5).any() and (labels_ < 0.5).any()
        scorers[name] = fit_scorer(sparse, labels_) if both else None
    return Classifier(stems, models, scorers)


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id``, ``broken``, ``abusive`` (probabilities) and ``keep`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        judge = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.asarray([judge.scores(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array((found < REJECT).all(axis=1))],
                ["doc_id", "broken", "abusive", "keep"])
        return one
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, broken double, abusive double, keep boolean", make)


def kept(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Rows of ``docs`` the classifier does not reject, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index("text")

    def run(batches):
        judge = shared.value
        for batch in batches:
            good = [max(judge.scores(t)) < REJECT for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
