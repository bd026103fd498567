"""Random rows and filters against plain Python."""

from collections import defaultdict
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidegauge.operators import breakdown as bd
from tidegauge.operators import timeseries as ts
from tidegauge.spec import Facet, FacetFilter, LogTable, Query, TimeRange

START = datetime(2026, 1, 1, 10, 0)
TABLE = LogTable("t", weight="weight", hosts=("name",), facets={
    "name": Facet("name", "name"), "status": Facet("status", "response_status"), "tags": Facet("tags", "tags", is_array=True)})
SCHEMA = "timestamp timestamp_ntz, name string, response_status int, weight int, tags array<string>"

row = st.tuples(st.integers(-120, 1200), st.sampled_from(["", "a", "b", "ab", "c%", "d_e"]),
                st.sampled_from([0, 200, 301, 399, 400, 404, 499, 500, 503]), st.integers(1, 9),
                st.lists(st.sampled_from("xyz"), max_size=3))
flt = st.one_of(
    st.builds(lambda v, e: FacetFilter("name", v, e), st.sampled_from(["", "a", "c%", "zz"]), st.booleans()),
    st.builds(lambda v, e: FacetFilter("response_status", v, e), st.sampled_from([200, 404, 503]), st.booleans()),
    st.builds(lambda v, e: FacetFilter("tags", v, e, op="HAS"), st.sampled_from("xy"), st.booleans()))
few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)


def holds(r, f):
    second, name, status, weight, tags = r
    return {"name": name == f.value, "response_status": status == f.value, "tags": f.value in tags}[f.col]


def passes(r, filters):
    by_column = defaultdict(list)
    for f in filters:
        by_column[f.col].append(f)
    for group in by_column.values():
        wanted = [f for f in group if not f.exclude]
        if wanted and not any(holds(r, f) for f in wanted):
            return False
        if any(holds(r, f) for f in group if f.exclude):
            return False
    return True


def counters(rows):
    return (sum(r[3] for r in rows), sum(r[3] for r in rows if r[2] < 400),
            sum(r[3] for r in rows if 400 <= r[2] < 500), sum(r[3] for r in rows if r[2] >= 500))


def frame(spark, data):
    return spark.createDataFrame([(START + timedelta(seconds=s), *rest) for s, *rest in data], SCHEMA)


RANGE = TimeRange.free(START, START + timedelta(minutes=15))


@few
@given(st.lists(row, max_size=40), st.lists(flt, max_size=4), st.sampled_from(["", "a", "%", "_"]), st.integers(1, 4))
def test_breakdowns(spark, data, filters, host, top):
    query = Query(RANGE, host=host, filters=tuple(filters), top=top)
    out = bd.breakdown(frame(spark, data), TABLE, TABLE.facets["name"], query, with_other=True).collect()
    # The facet ignores its own filters; the last minute counts whole.
    kept = [r for r in data if 0 <= r[0] < 16 * 60 and host in r[1] and passes(r, [f for f in filters if f.col != "name"])]
    groups = defaultdict(list)
    for r in kept:
        groups[r[1]].append(r)
    ranked = sorted(((k, counters(v)) for k, v in groups.items()), key=lambda g: (-g[1][0], g[0]))
    want = {("value", k): c for k, c in ranked[:top]}
    want["total", None] = counters(kept)
    if ranked[top:]:
        want["other", None] = tuple(sum(c[i] for _, c in ranked[top:]) for i in range(4))
    assert {(r.kind, r.dim): (r.cnt, r.cnt_ok, r.cnt_4xx, r.cnt_5xx) for r in out} == want


@few
@given(st.lists(row, max_size=40), st.lists(flt, max_size=3))
def test_array_elements(spark, data, filters):
    query = Query(RANGE, filters=tuple(filters), top=5)
    out = bd.breakdown(frame(spark, data), TABLE, TABLE.facets["tags"], query).collect()
    kept = [r for r in data if 0 <= r[0] < 16 * 60 and passes(r, [f for f in filters if f.col != "tags"])]
    want = {t: counters([r for r in kept for x in r[4] if x == t]) for t in {x for r in kept for x in r[4]}}
    assert {r.dim: (r.cnt, r.cnt_ok, r.cnt_4xx, r.cnt_5xx) for r in out if r.kind == "value"} == want


@few
@given(st.lists(row, max_size=40), st.lists(flt, max_size=3))
def test_series(spark, data, filters):
    query = Query(RANGE, filters=tuple(filters))
    out = {r.t: (r.cnt_ok, r.cnt_4xx, r.cnt_5xx) for r in ts.classes_over_time(frame(spark, data), TABLE, query).collect()}
    kept = [r for r in data if 0 <= r[0] < 16 * 60 and passes(r, filters)]
    want = {START + timedelta(seconds=s): (0, 0, 0) for s in range(0, 16 * 60 - 5, 5)}
    for slot in {r[0] // 5 * 5 for r in kept}:
        want[START + timedelta(seconds=slot)] = counters([r for r in kept if r[0] // 5 * 5 == slot])[1:]
    assert out == want


@few
@given(st.lists(row, max_size=30), st.integers(1, 3))
def test_selected_values_complete_the_top(spark, data, top):
    chosen = tuple(FacetFilter("name", v) for v in ("a", "ab", "zz"))
    query = Query(RANGE, filters=chosen, top=top)
    out = bd.missing_selected(frame(spark, data), TABLE, TABLE.facets["name"], query).collect()
    shown = [r.dim for r in out if r.kind == "value"]
    selected = {r.dim: r.cnt for r in out if r.kind == "selected"}
    kept = [r for r in data if 0 <= r[0] < 16 * 60]
    want = {v: sum(r[3] for r in kept if r[1] == v) for v in ("a", "ab") if v not in shown and any(r[1] == v for r in kept)}
    assert selected == want
