from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.traffic import MONTH
from tidegauge.functions import buckets
from tidegauge.functions.entities import with_entities
from tidegauge.operators import breakdown as bd
from tidegauge.plans.dashboards import APP_LOGS, AUTHORING_WORKERS, DASHBOARDS, DELIVERY, MIXER
from tidegauge.plans.facets import APP_LOG_ROLLUP, CDN_ROLLUP
from tidegauge.sources.rollup import merge_rollups, minute_rollup
from tidegauge.spec import Facet, FacetFilter, LogTable, Query, TimeRange

SF = "/root/testdata/sf0.001"
DAY = datetime(2026, 1, 1)
TABLE = LogTable("t", weight="weight", hosts=(), bytes="size", facets={})
TABLE_OF_MS = LogTable("t", hosts=(), facets={})
FACET = Facet("dim", "name")
QUERY = Query(TimeRange.free(DAY, datetime(2026, 1, 2)), top=2)


def facts(spark, data):
    return spark.createDataFrame([(DAY, *row) for row in data],
                                 "timestamp timestamp_ntz, name string, response_status int, weight int, size bigint")


def as_dict(df):
    return {(r.kind, r.dim): (r.cnt, r.cnt_ok, r.cnt_4xx, r.cnt_5xx) for r in df.collect()}


def test_null_values_are_not_mistaken_for_totals(spark):
    df = facts(spark, [(None, 200, 5, 1), ("a", 500, 1, 1), ("", 404, 3, 1)])
    out = as_dict(bd.breakdown(df, TABLE, FACET, replace(QUERY, top=5)))
    assert out == {("value", None): (5, 5, 0, 0), ("value", "a"): (1, 0, 0, 1), ("value", ""): (3, 0, 3, 0), ("total", None): (9, 5, 3, 1)}


def test_ties_at_the_cut_go_by_value_and_totals_ignore_it(spark):
    df = facts(spark, [(n, 200, 1, 1) for n in "dcba"])
    out = as_dict(bd.breakdown(df, TABLE, FACET, QUERY, with_other=True))
    assert set(out) == {("value", "a"), ("value", "b"), ("total", None), ("other", None)}
    assert out["total", None][0] == 4 and out["other", None][0] == 2


def test_no_other_row_when_everything_is_shown(spark):
    df = facts(spark, [("a", 200, 1, 1), ("b", 200, 1, 1)])
    assert ("other", None) not in as_dict(bd.breakdown(df, TABLE, FACET, QUERY, with_other=True))


def test_empty_result_has_zero_totals(spark):
    assert as_dict(bd.breakdown(facts(spark, []), TABLE, FACET, QUERY, with_other=True)) == {("total", None): (0, 0, 0, 0)}


def test_bytes_only_where_the_facet_offers_them(spark):
    df = facts(spark, [("a", 200, 3, 100)])
    by_bytes = replace(QUERY, by_bytes=True)
    assert as_dict(bd.breakdown(df, TABLE, FACET, by_bytes))["total", None][0] == 3
    assert as_dict(bd.breakdown(df, TABLE, replace(FACET, by_bytes=True), by_bytes))["total", None][0] == 300


def test_array_facets_count_every_occurrence(spark):
    df = spark.createDataFrame([(DAY, 200, ["x", "x", "y"]), (DAY, 200, []), (DAY, 500, None)],
                               "timestamp timestamp_ntz, response_status int, tags array<string>")
    table = LogTable("t", hosts=())
    out = as_dict(bd.breakdown(df, table, Facet("tags", "tags", is_array=True), QUERY))
    assert out["value", "x"][0] == 2 and out["total", None][0] == 3


def test_summary_share_of_nothing_is_null(spark):
    facet = replace(FACET, summary="response_status >= 500")
    assert bd.summary_share(bd.breakdown(facts(spark, []), TABLE, facet, QUERY)).first().summary_ratio is None
    some = facts(spark, [("a", 500, 1, 1), ("b", 200, 3, 1)])
    assert bd.summary_share(bd.breakdown(some, TABLE, facet, QUERY)).first().summary_ratio == 0.25


def test_bars_ignore_synthetic_values(spark):
    df = facts(spark, [("", 200, 100, 1), ("(same)", 200, 50, 1), ("a", 200, 10, 1), ("b", 404, 5, 1)])
    out = {r.dim: r for r in bd.bar_percentages(bd.breakdown(df, TABLE, FACET, replace(QUERY, top=5))).collect() if r.kind == "value"}
    assert out["b"].pct_bar == 50 and out["a"].pct_bar == 100 and out["b"].pct_4xx == 100


def test_selected_values_outside_the_top_are_appended(spark):
    df = facts(spark, [("a", 200, 9, 1), ("b", 200, 8, 1), ("c", 200, 1, 1)])
    chosen = tuple(FACET.filter(x) for x in ("a", "c", "nowhere", ""))
    out = as_dict(bd.missing_selected(df, replace(TABLE, facets={"dim": FACET}), FACET, replace(QUERY, filters=chosen)))
    assert out["selected", "c"] == (1, 1, 0, 0)
    assert {k for k, _ in out} == {"value", "total", "selected"} and len(out) == 4


def test_missing_labels_get_zero_rows_in_order(spark):
    facet = Facet("size", "size", raw="size", buckets=buckets.size_buckets, labels=buckets.size_labels)
    df = facts(spark, [("a", 200, 1, 0), ("a", 200, 1, 15), ("a", 500, 1, 10**9)])
    filled = bd.fill_labels(bd.breakdown(df, TABLE, facet, replace(QUERY, top=10)), facet.labels(10)).collect()
    assert [r.dim for r in filled] == facet.labels(10)
    assert [r.cnt for r in filled] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize("n", [3, 5, 7, 10, 12, 15, 20])
def test_bucket_labels(n):
    sizes, times, rates = buckets.size_labels(n), buckets.elapsed_labels(n), buckets.rate_labels(n)
    assert len(sizes) == len(times) == n and len(rates) == min(n, 11)
    assert sizes[0] == "0 (empty)" and sizes[-1].startswith("≥") and times[-1].startswith("≥")
    assert rates[-1] == "> 1000"
    for labels, case in ((sizes, buckets.size_buckets(n, "x")), (times, buckets.elapsed_buckets(n, "x")), (rates, buckets.rate_buckets(n, "x"))):
        assert all(f"'{label}'" in case for label in labels)


def test_bounds_round_halves_up():
    assert buckets.pick_evenly(tuple(range(6)), 3) == [0, 3, 5]
    assert buckets.pick_evenly((1, 2, 3), 1) == [3]
    assert buckets.elapsed_label(1500) == "1.5s" and buckets.elapsed_label(60000) == "60s"
    assert buckets.size_label(500) == "500 B" and buckets.size_label(20_000) == "20 KB" and buckets.size_label(0) == "0"


def test_bucket_edges(spark):
    case = buckets.elapsed_buckets(5, "x")
    out = spark.createDataFrame([(x,) for x in (0.5, 1.0, 60000.0)], "x double").select(F.expr(case)).collect()
    labels = buckets.elapsed_labels(5)
    assert [r[0] for r in out] == [labels[0], labels[1], labels[-1]]


# --- routing ----------------------------------------------------------------

PLAIN = replace(MONTH, host="", filters=(), where=None)


@pytest.mark.parametrize("table,facet,query,covered", [
    (DELIVERY, "status-range", PLAIN, True),
    (DELIVERY, "tier", PLAIN, True),
    (DELIVERY, "hosts", PLAIN, False),
    (DELIVERY, "asn", PLAIN, False),
    (DELIVERY, "content-length", PLAIN, False),
    (DELIVERY, "push-invalidation", PLAIN, False),
    (DELIVERY, "content-types", replace(PLAIN, by_bytes=True), False),
    (DELIVERY, "methods", replace(PLAIN, by_bytes=True), True),
    (DELIVERY, "methods", replace(PLAIN, host="x"), False),
    (DELIVERY, "methods", replace(PLAIN, where="true"), False),
    (DELIVERY, "methods", replace(PLAIN, filters=(DELIVERY.facets["source"].filter("a"),)), False),
    (DELIVERY, "methods", replace(PLAIN, owner_repo="a/b"), False),
    (DASHBOARDS["backend"], "methods", PLAIN, False),
    (APP_LOGS, "function-name", PLAIN, True),
    (APP_LOGS, "message", PLAIN, False),
    (APP_LOGS, "admin-duration", PLAIN, False),
])
def test_rollup_coverage(table, facet, query, covered):
    assert bd.rollup_covers(table, table.facets[facet], query) is covered


def test_forced_rollup_must_cover(spark):
    with pytest.raises(ValueError):
        bd.pick_source(None, None, DELIVERY, DELIVERY.facets["hosts"], PLAIN, source="rollup")


@pytest.mark.parametrize("table,columns,load", [
    (DELIVERY, CDN_ROLLUP, views.access),
    (APP_LOGS, APP_LOG_ROLLUP, lambda s, sf: with_entities(views.app_log_in(s, sf))),
])
def test_rollup_answers_like_the_rows(spark, rows, table, columns, load):
    df = load(spark, SF).persist()
    half = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp_ntz")
    rollup = merge_rollups(minute_rollup(df.filter(half), table, columns), minute_rollup(df.filter(~half), table, columns)).persist()
    covered = [f for f in table.facets.values() if bd.rollup_covers(table, f, PLAIN)]
    assert len(covered) >= 7
    for facet in covered:
        raw = bd.breakdown(df, table, facet, PLAIN, with_other=True)
        assert rows(raw) == rows(bd.rollup_breakdown(rollup, facet, PLAIN, with_other=True)), facet.name


@pytest.mark.parametrize("table,load,by_bytes", [
    (DELIVERY, views.access, False), (DELIVERY, views.access, True), (MIXER, views.worker, False)])
def test_all_facets_equal_single_breakdowns(spark, rows, table, load, by_bytes):
    df = load(spark, SF).persist()
    facets = [f for f in table.facets.values() if not f.buckets]
    filters = (table.facets["status"].filter("200"), FacetFilter("unknown_column", "x"))
    query = replace(PLAIN, filters=filters, by_bytes=by_bytes)
    combined = bd.all_facets(df, table, facets, query, with_other=True).persist()
    for facet in facets:
        single = bd.breakdown(df, table, facet, query, with_other=True)
        if "summary_cnt" not in single.columns:
            single = single.withColumn("summary_cnt", F.lit(None).cast("bigint"))
        assert rows(combined.filter(F.col("facet") == facet.name).drop("facet")) == rows(single), facet.name


def test_catalogue_sizes():
    sizes = {t.name: len(t.facets) for t in DASHBOARDS.values()}
    assert sizes == {"delivery": 41, "backend": 41, "admin": 41, "authoring": 21, "authoring_worker_logs": 9, "mixer_logs": 9, "lambda_logs": 14}


def test_overlapping_worker_classes(spark):
    df = spark.createDataFrame([(DAY, "exception", 404), (DAY, "ok", 0), (DAY, "ok", 503)],
                               "timestamp timestamp_ntz, outcome string, response_status int")
    out = as_dict(bd.breakdown(df, AUTHORING_WORKERS, AUTHORING_WORKERS.facets["outcome"], QUERY))
    assert out["value", "exception"] == (1, 0, 1, 1) and out["value", "ok"] == (2, 1, 0, 1)


def test_unknown_numbers_count_in_the_totals_only(spark):
    df = spark.createDataFrame([(DAY, 200, 5), (DAY, 200, None), (DAY, 500, 70_000)], "timestamp timestamp_ntz, response_status int, ms int")
    facet = Facet("elapsed", "ms", raw="ms", buckets=buckets.elapsed_buckets, labels=buckets.elapsed_labels)
    for query in (replace(QUERY, top=10), replace(QUERY, top=1)):
        out = as_dict(bd.breakdown(df, TABLE_OF_MS, facet, query))
        assert out["total", None][0] == 3 and ("value", None) not in out
    page = {(r.kind, r.dim): r.cnt for r in bd.page_breakdowns(df, TABLE_OF_MS, [facet], replace(QUERY, top=10)).collect()}
    assert page == {("value", "5ms-20ms"): 1, ("value", "≥ 60s"): 1, ("total", None): 3}


def test_one_name_per_number_and_only_in_its_facet(spark):
    df = spark.createDataFrame([(DAY, 200, 200), (DAY, 200, 7)], "timestamp timestamp_ntz, response_status int, asn int")
    names = spark.createDataFrame([(200, "b"), (200, "a"), (7, "c")], "asn int, name string")
    facets = [Facet("status", "cast(response_status AS string)"), Facet("asn", "cast(asn AS string)", dictionary=True)]
    out = sorted((r.facet, r.dim, r.cnt) for r in bd.page_breakdowns(df, TABLE_OF_MS, facets, QUERY, names).filter("kind = 'value'").collect())
    assert out == [("asn", "200 b", 1), ("asn", "7 c", 1), ("status", "200", 2)]


def test_a_page_reads_its_rows_in_few_scans(spark, tmp_path):
    """41 facets of the delivery page: seven scans of the rows; with a roll-up the covered facets cost one scan of it."""
    path = str(tmp_path / "rows")
    views.access(spark, SF).write.parquet(path)
    rows = spark.read.parquet(path)
    minute_rollup(rows, DELIVERY, CDN_ROLLUP).write.parquet(str(tmp_path / "minutes"))
    rollup = spark.read.parquet(str(tmp_path / "minutes"))
    for more, scans in (({}, 7), ({"rollup": rollup}, 6)):
        page = bd.page_breakdowns(rows, DELIVERY, DELIVERY.facets.values(), PLAIN, **more)
        page.collect()
        ran = page._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert 1 < ran.count("FileScan") <= scans


def test_facts_are_scanned_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    facts(spark, [(str(i % 9), 200, 1, 1) for i in range(200)]).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (bd.breakdown(df, TABLE, FACET, QUERY, with_other=True),
                bd.all_facets(df, TABLE, [FACET, replace(FACET, name="n2", dim="upper(name)")], QUERY, with_other=True)):
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1


def _counted(spark, counts):
    """One row per value with its weight, a hash apart, and some with none."""
    rows = [(v, w, 200 if i % 3 else 503) for i, (v, w) in enumerate(counts)]
    return spark.createDataFrame(rows, "v string, weight bigint, response_status int").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:30' AS timestamp").repartition(3)


@pytest.mark.parametrize("counts", [
    [(f"v{i}", 1) for i in range(400)],                                              # even
    [(f"v{i}", 1000 // (i + 1)) for i in range(400)],                                # skewed
    [(f"v{i}", 50) for i in range(12)] + [(f"w{i}", 49 + i % 2) for i in range(300)],  # many at the bound
    [(None, 7), ("", 7), ("a", 7)],                                                  # fewer than asked for
    [(f"x{i}", 3) for i in range(500)] + [("hot", 4)],                               # one above a crowd
    [(f"z{i}", 0) for i in range(30)],
    [],
])
def test_sparse_breakdown_equals_breakdown(spark, rows, counts):
    """With as few as four buckets, where values hide behind each other, and with many."""
    from dataclasses import replace as changed
    facet = Facet("v", "v", summary="response_status = 503")
    table = LogTable("t", weight="weight", facets={"v": facet}, hosts=(), owner="v", repo="v")
    query = Query(TimeRange.free(datetime(2024, 1, 1), datetime(2024, 1, 2)), top=5)
    df = _counted(spark, counts)
    for top in (5, 20):
        asked = changed(query, top=top)
        want = rows(bd.breakdown(df, table, facet, asked, with_other=True))
        for buckets in (4, 64, 1 << 16):
            assert rows(bd.sparse_breakdown(df, table, facet, asked, with_other=True, buckets=buckets)) == want


def test_sparse_breakdown_leaves_most_values_where_they_are(spark, monkeypatch):
    """A long tail of values behind a few leading ones: hardly any value is shuffled, and no third scan is made."""
    facet = Facet("v", "v")
    table = LogTable("t", weight="weight", facets={"v": facet}, hosts=(), owner="v", repo="v")
    query = Query(TimeRange.free(datetime(2024, 1, 1), datetime(2024, 1, 2)), top=5)
    df = _counted(spark, [(f"tail{i}", 1) for i in range(20_000)] + [(f"head{i}", 500 - i) for i in range(9)])
    exact, seen = bd._exact_top, []

    def counting(chosen, n):
        seen.append(chosen.select("dim").distinct().count())
        return exact(chosen, n)
    monkeypatch.setattr(bd, "_exact_top", counting)
    found = bd.sparse_breakdown(df, table, facet, query).collect()
    assert [r.dim for r in found if r.kind == "value"] == [f"head{i}" for i in range(5)] and found[-1].cnt == 20_000 + sum(500 - i for i in range(9))
    assert len(seen) == 1 and seen[0] < 300  # of 20,009


def test_sparse_breakdown_of_arrays_and_buckets(spark):
    facet = Facet("v", "v", is_array=True)
    table = LogTable("t", facets={"v": facet}, hosts=(), owner="o", repo="o")
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "v array<string>").selectExpr(
        "v", "'' AS o", "200 AS response_status", "timestamp_ntz '2024-01-01 00:00:30' AS timestamp")
    query = Query(TimeRange.free(datetime(2024, 1, 1), datetime(2024, 1, 2)), top=5)
    assert [(r.kind, r.dim, r.cnt) for r in bd.sparse_breakdown(df, table, facet, query).collect()] == [("value", "a", 2), ("value", "b", 1), ("total", None, 3)]
    with pytest.raises(ValueError):
        bd.sparse_breakdown(df, table, Facet("n", "n", raw="n", buckets=lambda n, x: x, labels=lambda n: []), query)
