import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import anomaly as an

T0 = datetime(2026, 1, 12, 21, 4)
SCHEMA = "key string, t timestamp_ntz, cnt_ok bigint, cnt_4xx bigint, cnt_5xx bigint"


def frame(spark, series):
    """{key: [(ok, 4xx, 5xx), ...]} as a series table of one-minute buckets."""
    return spark.createDataFrame([(k, T0 + timedelta(minutes=i), *p) for k, points in series.items()
                                  for i, p in enumerate(points)], SCHEMA)


def found(spark, points, margin=2, most=5):
    out = an.detect(frame(spark, {"s": points}), ["key"], margin, most).orderBy("rank").collect()
    return [(r.category, r.type, r.start, r.end) for r in out]


def flat(n, base=(100, 10, 1), **changes):
    points = [list(base) for _ in range(n)]
    for name, spans in changes.items():
        column = ("ok", "client", "server").index(name)
        for span, value in spans.items():
            for i in span:
                points[i][column] = value
    return [tuple(p) for p in points]


# --- brute force ------------------------------------------------------------

def runs(values, valid, beyond):
    """Maximal runs of consecutive valid indexes whose value satisfies ``beyond``."""
    hits = [i for i in valid if beyond(values[i])]
    out = []
    for i in hits:
        if out and out[-1][-1] == i - 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def expected(points, margin, most=5):
    if len(points) < 8:
        return []
    valid = range(2, len(points) - margin)
    candidates = []
    for order, (category, column, kind, weight) in enumerate(an.KINDS):
        values = [p[("cnt_ok", "cnt_4xx", "cnt_5xx").index(column)] for p in points]
        part = [values[i] for i in valid]
        base = statistics.median(part) if part else 0
        dev = [(v - base) / base if base > 0 else 0.0 for v in values]
        sigma = statistics.pstdev([dev[i] for i in valid]) if len(part) > 1 else 0.0
        beyond = (lambda d, s=sigma: d > s + 1e-12) if kind == "spike" else (lambda d, s=sigma: d < -s - 1e-12)
        for run in runs(dev, valid, beyond):
            peak = max(abs(dev[i]) for i in run)
            candidates.append((-peak * math.sqrt(len(run)) * weight, order, run[0], run[-1], category, kind))
    candidates.sort()
    chosen = []
    for c in candidates:
        def reach(x):
            return math.ceil((x[3] - x[2] + 1) / 2)
        if len(chosen) < most and all(c[3] < o[2] - reach(o) - reach(c) or c[2] > o[3] + reach(o) + reach(c) for o in chosen):
            chosen.append(c)
    return [(c[4], c[5], c[2], c[3]) for c in chosen]


def test_random_series_match_brute_force(spark):
    rng = random.Random(7)
    series = {}
    for n in range(60):
        length = rng.randint(6, 70)
        points = [(rng.randint(80, 120), rng.randint(0, 20), rng.choice([0, 0, 1, 2, 3])) for _ in range(length)]
        for _ in range(rng.randint(0, 4)):
            at, width, factor = rng.randrange(length), rng.randint(1, 8), rng.choice([0, 2, 5, 9])
            for i in range(at, min(length, at + width)):
                points[i] = tuple(x * factor for x in points[i])
        series[f"k{n}"] = points
    out = an.detect(frame(spark, series), ["key"], 2).collect()
    got = {k: [] for k in series}
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.key].append((r.category, r.type, r.start, r.end))
    assert got == {k: expected(p, 2) for k, p in series.items()}
    assert any(len(v) > 1 for v in got.values())


# --- rules ------------------------------------------------------------------

def test_short_series_have_none(spark):
    assert found(spark, flat(7, server={(4,): 50})) == []


def test_stable_series_have_none(spark):
    assert found(spark, flat(30)) == []


def test_end_margin_hides_a_spike_at_the_end(spark):
    points = flat(15, server={(13, 14): 40})
    assert found(spark, points, margin=2) == []
    assert found(spark, points, margin=0) == [("red", "spike", 13, 14)]


def test_open_region_ends_before_the_margin(spark):
    assert found(spark, flat(20, server={tuple(range(15, 20)): 40}), margin=2) == [("red", "spike", 15, 17)]


def test_wide_regions_keep_neighbours_away(spark):
    points = flat(40, base=(100, 5, 1), server={tuple(range(10, 16)): 60, tuple(range(19, 25)): 50})
    assert found(spark, points) == [("red", "spike", 10, 15)]


def test_narrow_regions_may_be_close(spark):
    points = flat(40, server={(10,): 60, (13,): 50})
    assert found(spark, points) == [("red", "spike", 10, 10), ("red", "spike", 13, 13)]


def test_traffic_loss_is_a_dip(spark):
    assert found(spark, flat(30, ok={(10, 11, 12): 10})) == [("green", "dip", 10, 12)]


def test_at_most_five(spark):
    points = flat(100, server={tuple(range(10 * i, 10 * i + 1)): 50 + i for i in range(1, 9)})
    assert len(found(spark, points)) == 5


def test_ties_go_to_red_before_yellow(spark):
    points = flat(40, base=(100, 10, 10), client={(20,): 50}, server={(10,): 50})
    assert [f[0] for f in found(spark, points)] == ["red", "yellow"]


def test_zero_baseline_has_no_deviation(spark):
    assert found(spark, flat(30, base=(100, 0, 0), server={(10,): 99})) == []


def single(spark, points):
    r = an.detect_single(frame(spark, {"s": points}), ["key"]).first()
    return r and (r.category, r.type, r.start, r.end)


def test_single_winner(spark):
    assert single(spark, flat(30)) is None
    assert single(spark, flat(30, server={(8,): 9})) == ("error", "spike", 8, 8)
    # Loss of traffic outweighs a gain of the same size; errors outweigh both.
    assert single(spark, flat(30, ok={(10,): 40, (20,): 160})) == ("success", "dip", 10, 10)
    assert single(spark, flat(30, ok={(10,): 40}, server={(20,): 60})) == ("error", "spike", 20, 20)


def test_longer_wins_among_equals(spark):
    assert single(spark, flat(40, server={(8,): 9, (20, 21, 22): 9})) == ("error", "spike", 20, 22)


def test_margin_from_the_clock(spark):
    points = flat(20)
    df = frame(spark, {"a": points, "b": points[:4]})
    now = T0 + timedelta(minutes=20)
    out = {r.key: (r.end_margin, r.long_enough) for r in an.end_margin(df, ["key"], now).collect()}
    assert out == {"a": (3, True), "b": (0, False)}


def test_series_are_independent(spark):
    a, b = flat(30, server={(10,): 50}), flat(30, ok={(12,): 1})
    both = an.detect(frame(spark, {"a": a, "b": b}), ["key"])
    assert {(r.key, r.category) for r in both.collect()} == {("a", "red"), ("b", "green")}


def test_highlight(spark):
    df = spark.createDataFrame([("g", f"d{i:02d}", i) for i in range(40)], "g string, dim string, score int")
    out = an.top_contributors(df, ["g"], "score").orderBy("rank").collect()
    assert len(out) == 30 and [r.highlight for r in out[:4]] == [True, True, True, False] and out[0].dim == "d39"


@pytest.mark.parametrize("most", [1, 2])
def test_selection_needs_no_python(spark, most):
    plan = an.detect(frame(spark, {"s": flat(30, server={(10,): 50})}), ["key"], most=most)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_all_deviations_are_finite(spark):
    out = an.deviations(frame(spark, {"s": flat(30, base=(0, 0, 0))}), ["key"])
    assert out.filter(F.isnan("deviation") | F.col("deviation").isNull()).count() == 0


def test_contrast_of_many_equals_contrast_of_each(spark, tmp_path):
    """Anomalies of keyed series, NULL keys and values included, over all facets at once: the rows of one contrast each, from one scan."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from tidegauge.operators import anomaly as an
    from tidegauge.spec import Facet, FacetFilter, LogTable, Query, TimeRange

    rows = spark.range(4000).selectExpr(
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, id % 120, id % 60) AS timestamp", "CAST(1 + id % 3 AS bigint) AS weight",
        "CAST(CASE WHEN id % 7 = 0 THEN 503 WHEN id % 5 = 0 THEN 404 ELSE 200 END AS int) AS response_status", "nullif(concat('h', id % 3), 'h2') AS host",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('p', (id * id) % 97) END AS path", "concat('m', id % 2) AS method")
    facets = {"path": Facet("path", "path"), "method": Facet("method", "method"), "odd": Facet("odd", "path", extra="path LIKE '%1'")}
    table = LogTable("t", weight="weight", facets=facets, hosts=(), owner="host", repo="host")
    start = datetime(2024, 1, 1)
    query = Query(TimeRange(start, start + timedelta(minutes=119), timedelta(minutes=1)), filters=(FacetFilter("method", "m1"),))
    at = [start + timedelta(minutes=m) for m in (3, 9, 40, 40, 200)]
    spans = [("h0", 1, "red", at[0], at[1]), ("h0", 2, "green", at[2], at[3]), ("h1", 1, "yellow", at[0], at[2]), (None, 1, "red", at[0], at[1]), ("h1", 2, "red", at[4], at[4])]
    found = spark.createDataFrame(spans, "host string, rank int, category string, start_time timestamp_ntz, end_time timestamp_ntz")
    rows.write.parquet(f"{tmp_path}/rows")
    facts = spark.read.parquet(f"{tmp_path}/rows")
    got = an.contrast_anomalies(facts, table, list(facets.values()), query, found, {"host": "host"}, rows=7)
    listed = {}
    for r in got.collect():
        listed.setdefault((r.host, r.rank, r.facet), []).append((r.place, r.dim, r.anomaly_cat_cnt, r.baseline_cat_cnt, r.anomaly_total_cnt, r.baseline_total_cnt))
    for host, rank, category, a, b in spans:
        for name, facet in facets.items():
            one = an.contrast_anomaly(facts.filter(F.col("host").eqNullSafe(F.lit(host))), table, facet, query, [(a, b)], category, rows=7)
            want = [(i, *r) for i, r in enumerate(one.collect(), 1)]
            assert sorted(listed.pop((host, rank, name), [])) == want, (host, rank, name)
    assert not listed
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scans = {line.split("Scan parquet")[1] for line in plan.split("Initial Plan")[0].splitlines() if "Scan parquet" in line}
    assert len(scans) == 1 and plan.split("Initial Plan")[0].count("Scan parquet") == 1  # read once, then reused
    none = an.contrast_anomalies(facts, table, list(facets.values()), query, found.limit(0), {"host": "host"})
    assert none.count() == 0
