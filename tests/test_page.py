"""The page facade: every query of a dashboard from one place."""

from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.traffic import MONTH
from tidegauge.functions.entities import with_entities
from tidegauge.plans.dashboards import APP_LOGS, AUTHORING_WORKERS, DELIVERY
from tidegauge.plans.facets import CDN_ROLLUP
from tidegauge.plans.page import Page
from tidegauge.sources.rollup import compact_rollup, merge_rollups, minute_rollup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def page(spark, tmp_path_factory):
    facts = views.access(spark, SF).persist()
    path = str(tmp_path_factory.mktemp("rollup") / "r")
    compact_rollup(minute_rollup(facts, DELIVERY, CDN_ROLLUP), path)
    names = views.table(spark, SF, "nation").select(F.col("n_nationkey").alias("asn"), F.col("n_name").alias("name"))
    return Page(replace(DELIVERY, id="event_id"), facts, spark.read.parquet(path), names, "dt")


def test_every_facet_answers(page):
    for name in page.table.facets:
        out = page.breakdown(name, MONTH).collect()
        assert sum(r.kind == "total" for r in out) == 1, name
        assert all(r.cnt == r.cnt_ok + r.cnt_4xx + r.cnt_5xx for r in out), name


def test_rows_and_rollup_agree(page, rows):
    for name in ("status-range", "tier", "methods", "errors"):
        assert rows(page.breakdown(name, MONTH)) == rows(page.breakdown(name, MONTH, source="raw")), name


def test_all_facets_at_once(page):
    out = page.breakdowns(MONTH)
    totals = {r.facet for r in out.filter("kind = 'total'").collect()}
    assert totals == set(page.table.facets)
    asn = out.filter("facet = 'asn' AND kind = 'value'").first().dim
    assert " " in asn


def test_selected_values_are_kept(page):
    facet = page.table.facets["hosts"]
    rare = page.facts.groupBy("request_host").agg(F.sum("weight").alias("w")).orderBy("w", "request_host").first()[0]
    out = page.breakdown("hosts", replace(MONTH, top=5, filters=(facet.filter(rare),)))
    assert [r.dim for r in out.filter("kind = 'selected'").collect()] == [rare]


def test_series_and_anomalies(page):
    series = page.series(MONTH)
    assert series.agg(F.sum(F.col("cnt_ok") + F.col("cnt_4xx") + F.col("cnt_5xx"))).first()[0] == page.facts.agg(F.sum("weight")).first()[0]
    daily = replace(MONTH, range=replace(views.MONTH, step=timedelta(days=1)))
    found = page.anomalies(daily, views.AS_OF, ["platform_org"])
    assert 1 <= found.groupBy("platform_org").count().agg(F.max("count")).first()[0] <= 5


def test_logs_and_search(page):
    assert page.logs(MONTH).count() == 500
    top = page.breakdown("hosts", replace(MONTH, top=5), source="raw").filter("kind = 'value'")
    following = page.search("hosts", replace(MONTH, top=5))
    assert top.join(following, "dim").count() == 0 and following.count() == 20
    assert page.search("hosts", MONTH, "site1").filter("NOT contains(dim, 'site1')").count() == 0


def test_labels(page):
    assert page.labelled("time-elapsed", MONTH).count() == MONTH.top


@pytest.mark.parametrize("table,load", [
    (AUTHORING_WORKERS, views.worker), (APP_LOGS, lambda s, sf: with_entities(views.app_log_in(s, sf)))])
def test_other_tables(spark, table, load):
    other = Page(table, load(spark, SF).persist())
    names = {r.facet for r in other.breakdowns(MONTH).filter("kind = 'total'").collect()}
    assert names == set(table.facets)
    assert other.series(MONTH).count() >= 4320


def test_compaction_keeps_the_sums(spark, rows, tmp_path):
    facts = views.access(spark, SF)
    parts = [minute_rollup(facts.filter(c), DELIVERY, CDN_ROLLUP) for c in ("k < 50", "k >= 50")]
    compact_rollup(parts[0].unionByName(parts[1]), str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert rows(stored.drop("dt")) == rows(merge_rollups(*parts))
