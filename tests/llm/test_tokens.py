import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import binary, packing, tokens

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
PARTS = ["a", "the", "The", "Thing's", " ", "  ", "\n", " \n", "\n ", "\t", "é", "é", "123", "!", "***", "<|endoftext|>", "\x00", "　",
         "\xa0", "ß", "中文", "😀", "'s", "İ", "\r\n", "\x1c", "\x85", "x" * 70, "‍", "ﬁ", "Ⅷ", "_", "-", ".", "̇"]


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def ids(coder, text):
    return np.asarray(coder.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name,spaced", KINDS)
def test_ids_are_those_of_the_library(name, spaced):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", *("".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(3000))]
    coder, plain = tokens.Encoder(public_tokenizers.path(name), spaced), library(name)
    for _ in range(2):  # new pieces, then remembered ones
        assert coder.encode(texts) == [ids(plain, t) for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    assert coder.encode(["a b c d e"]) == coder.encode(["a b c d e"])


DOCS = [(3, "Of. the and"), (1, None), (2, ""), (5, "word " * 5000), (5, "again"), (None, "no id"), (9, "the\nend")]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, "x", 7, t) for i, t in rows], "doc_id long, text string, ids string, part int, start string")


def test_orc_round_trip(spark, tmp_path):
    path, plain = str(tmp_path / "ids"), library("word_bpe_49k.json")
    binary.write_ids(frame(spark), path, public_tokenizers.path("word_bpe_49k.json"), False, 2)
    read = binary.with_checksums(binary.read_ids(spark, path)).collect()
    want = sorted(((i if i is not None else -1, ids(plain, t) + b"\x02\0\0\0") for i, t in DOCS), key=lambda x: x[0])
    got = sorted(read, key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    assert sorted((r.n_tokens, r.ids_crc32) for r in read) == sorted((len(raw) // 4, zlib.crc32(raw)) for _, raw in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    found = binary.find_ids(spark, path, [9])
    assert [r.n_tokens for r in found.collect()] == [3]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id,9)" in found._jdf.queryExecution().toString()
    binary.write_ids(frame(spark).limit(0), str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json"), False, 2)
    assert binary.read_ids(spark, str(tmp_path / "none")).collect() == []


def check_packed(rows, texts, window=2048):
    plain = library("byte_bpe_50k.json")
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    whole = [ids(plain, t) + b"\x01\0\0\0" for _, t in texts]
    pieces = sorted((len(raw) // 4, at // 4, zlib.crc32(raw[at:at + 4 * window])) for raw in whole for at in range(0, len(raw), 4 * window))
    assert sorted((r.doc_tokens, r.start, r.ids_crc32) for r in rows) == pieces
    return len(by_sequence)


def test_packing_places_every_token_once(spark, prose):
    rng = random.Random(1)
    texts = [*DOCS, *((100 + i, prose(i, rng.randint(1, 900))) for i in range(300)), *((1000 + i, "same text") for i in range(50))]
    rows = packing.packed(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), True, 1).collect()
    n = check_packed(rows, texts)
    assert sum(r.length for r in rows) > 0.97 * 2048 * (n - 1)
    assert packing.packed(frame(spark, texts[:1]).limit(0), public_tokenizers.path("byte_bpe_50k.json"), True, 1).collect() == []


def test_sequences_hold_the_ids(spark, prose):
    docs = frame(spark, [(i, prose(i, 700)) for i in range(20)])
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tidegauge.llm.common import written
    cut = written(packing.pieces(docs, path, True, 1, with_ids=True), "pieces")
    for r in packing.sequences(packing.pack(cut), 0).collect():
        assert len(r.ids) == 2048 or len(r.ids) == r.n_tokens and r.n_tokens & (r.n_tokens - 1) == 0


@pytest.mark.parametrize("histogram", [{}, {256: 5}, {1: 5000}, {200: 300}, {100: 777, 3: 7}, {c: c * 7 % 13 for c in range(1, 257)}])
def test_recipes_use_every_piece(histogram):
    counts = np.zeros(257, np.int64)
    for c, n in histogram.items():
        counts[c] = n
    used = np.zeros(257, np.int64)
    for repeats, kinds in packing.recipes(counts):
        assert sum(kinds) <= 256 and repeats > 0
        for c in kinds:
            used[c] += repeats
    assert (used == counts).all()


def test_least_squares_against_exhaustive_search():
    matrix = np.asarray([[1.0, 0, 1, 2], [0, 1, 1, 0], [1, 1, 0, 1]])
    for target in ([1.0, 2, 3], [5, 0, 1], [0, 0, 0], [2, 9, 4]):
        target = np.asarray(target, float)
        x = packing.nnls(matrix, target, 50)
        best = min(np.linalg.norm(matrix[:, list(s)] @ np.linalg.lstsq(matrix[:, list(s)], target, rcond=None)[0] - target)
                   for k in range(1, 16) if (s := [j for j in range(4) if k >> j & 1])
                   and (np.linalg.lstsq(matrix[:, list(s)], target, rcond=None)[0] >= -1e-9).all()) if target.any() else 0
        assert (x >= 0).all() and abs(np.linalg.norm(matrix @ x - target) - best) < 1e-4
