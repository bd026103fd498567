import hashlib
import random
import re
import zlib

import pytest

from tidegauge.llm import repair as r

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(kinds):
    """(cost, audit) by a table over rows and last roles; kinds are (initial, must go, broken)."""
    best = {"": (0, ""), "a": (0, ""), "s": (10, "II"), "u": (5, "I")}
    for initial, gone, broken in reversed(kinds):
        now = {}
        for state in AFTER:
            ways = [(2 + best[state][0], "D" + best[state][1])]
            if not gone:
                extra = 5 if broken else 0
                if initial == AFTER[state] or (initial == "s" and state == ""):
                    ways.append((extra + best[initial][0], "K" + best[initial][1]))
                ways.append((1 + extra + best[AFTER[state]][0], "R" + best[AFTER[state]][1]))
            now[state] = min(ways)
        for _ in range(4):
            now = {s: min(now[s], (5 + now[AFTER[s]][0], "I" + now[AFTER[s]][1])) for s in now}
        best = now
    return best[""]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs.setdefault(conv, [])
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        convs[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        kinds, seen, n = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [role[:1] for _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(kinds)
        said, state, at = [], "", 0
        for edit in audit:
            if edit == "I":
                state = AFTER[state]
                said.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            _, role, text = found[at]
            at += 1
            if edit == "K":
                state = role[0]
                said.append(f"{role}:{text}")
            elif edit == "R":
                state = AFTER[state]
                said.append({"u": "user", "a": "assistant"}[state] + ":" + text)
        assert at == len(found) and re.fullmatch("(s?(ua)+)?", "".join(s[0] for s in said))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "Assistant"])
            text = rng.choice([f"said {t}.", f"cut off {t}", "ok!", "ok!", "", " \n", None, "what?\t", f"{t}… é", "a\x0bb ."])
            rows.append((c, rng.choice([t, t, t + 1, t + 5]), role, text))
    return rows


def test_auction_finds_the_least_cheapest_audit():
    rng = random.Random(1)
    for n in [*range(8), 15, 16, 17, 33, 60]:
        for _ in range(60):
            kinds = [(rng.choice("suaot"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            letters = "".join("x" if gone else (i if i in "sua" else "o").upper() if broken else i if i in "sua" else "o" for i, gone, broken in kinds)
            assert r.repair(letters) == cheapest(kinds)


def test_prices_are_dual_feasible():
    """No price exceeds an arc's cost plus the price behind it, and entries have equality somewhere."""
    one = r.Lattice("uuxASoaU", (0, 3, 5, 2))
    for node, arcs in one.arcs.items():
        assert all(one.price[node] <= cost + one.price[i, s] for _, cost, i, s in arcs)
    assert all(one.least(s)[0] for s in range(4))


@pytest.mark.parametrize("part", [r.PART, 2])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(r, "PART", part)
    rows = made(4, 120)
    rows += [(500, t, role, f"turn {t}.") for t in range(700) for role in (["user", "assistant"][t % 2],)]  # a long one
    rows += [(501, None, None, None), (501, None, "user", "x."), (501, 3, "user", "x."), (None, 1, "user", "q?"), (None, None, "assistant", "a.")]
    rows += [(502, 1, "user", "same.")] * 30 + [(502, 2, "user", "same.")] * 3
    rows += [(c, 0, "user", "dropped") for c in range(600, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = r.repaired(r.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows)
    assert any(x[7] == "" and x[6] == 0 for x in brute(rows))  # a conversation that lost all rows


def test_given_table_empty_and_other_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(x) for x in df.select("conv_id", "turn", "role", "text").collect()]
    wide = df.selectExpr("*", "1 AS copies", "'x' AS sha", "role AS kind")
    assert sorted((tuple(x) for x in r.repaired(r.damaged(wide)).collect()), key=str) == brute(rows)
    assert r.repaired(r.damaged(df.limit(0))).count() == 0
