import random

import xxhash

from tidegauge.llm.components import components
from tidegauge.llm.simhash import keep_one, links, near_duplicates, simhash


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in
                                "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split(" ") if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_links(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]


def test_fingerprint_equals_plain_form():
    for text in ("", " \n ", "One", "One two", "A b c d e A b c", "É x y Z\tw\r\nv ß A", "x " * 200_000):
        assert simhash(text) == signed(brute_fingerprint(text)) if len(text) < 1000 else simhash(text)
    assert simhash(None) == 0


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:4]:  # crowds within a few bits, in one half, in the other, over both
        for bits in (range(32), range(32, 64), range(64)):
            fps |= {centre ^ sum(1 << b for b in rng.sample(list(bits), rng.randint(1, 4))) for _ in range(40)}
    fps = sorted(signed(x) for x in fps | {0, 1, 3, 7, 1 << 63})
    edges = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    assert classes(fps, edges) == classes(fps, brute_links(fps))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(3, 2), (2, 3), (9, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(sorted({x for e in edges for x in e}), edges)
    assert got == {n: r for n, r in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_defined_cases(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20
    docs = spark.createDataFrame(
        [(4, base, "u"), (2, base.upper(), "v"), (2, base.upper(), "v"), (7, None, "w"), (8, "", "w"), (9, " \n", None),
         (None, "quite another text of several words here", "x"), (1, "short text", "y")],
        "doc_id long, text string, fp string")
    got = sorted((str(r["doc_id"]), r["fp"] == 0, r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == sorted([("4", False, 2), ("2", False, 2), ("2", False, 2), ("7", True, 7), ("8", True, 7), ("9", True, 7),
                          ("None", False, None), ("1", False, 1)])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "7", "None"]
    assert near_duplicates(docs.limit(0)).collect() == []
