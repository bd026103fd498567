"""One key holds most rows: results stay whole, and no task gathers the key."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import anomaly as an
from tidegauge.operators import breakdown as bd
from tidegauge.operators import listing, lookups
from tidegauge.operators import timeseries as ts
from tidegauge.sources import writers
from tidegauge.spec import Facet, LogTable, Query, TimeRange

N = 120_000
START = datetime(2026, 1, 1)
TABLE = LogTable("t", weight="weight", hosts=(), id="id")
QUERY = Query(TimeRange.free(START, START + timedelta(days=2)), top=5)
HOT = Facet("host", "host")


@pytest.fixture(scope="module")
def facts(spark):
    """Half of all rows come from one host, and half of those in one minute."""
    hot = F.col("id") % 2 == 0
    second = F.when(hot & (F.col("id") % 4 == 0), F.lit(3600)).otherwise((F.col("id") * 7919) % 172800)
    return spark.range(0, N, 1, 8).select(
        "id", (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=second)).cast("timestamp_ntz").alias("timestamp"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 1000).cast("string"))).alias("host"),
        F.when(F.col("id") % 11 == 0, 503).otherwise(200).alias("response_status"),
        (F.col("id") % 3 + 1).cast("int").alias("weight")).persist()


def shuffled(df):
    """Rows written by each shuffle of the executed plan, largest first."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found = []

    def walk(node):
        metrics = node.metrics()
        if "shuffleRecordsWritten" in [metrics.keys().toList().apply(i) for i in range(metrics.size())]:
            found.append(metrics.apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(found, reverse=True)


def test_breakdown_ships_groups_not_rows(facts):
    out = bd.breakdown(facts, TABLE, HOT, QUERY, with_other=True)
    rows = {(r.kind, r.dim): r.cnt for r in out.collect()}
    total = facts.agg(F.sum("weight")).first()[0]
    assert rows["total", None] == total
    assert rows["value", "hot"] == facts.filter("host = 'hot'").agg(F.sum("weight")).first()[0]
    assert sum(v for (k, _), v in rows.items() if k != "total") == total
    assert shuffled(out)[0] <= 501 * 8


def test_all_facets_with_a_hot_facet(facts):
    out = bd.all_facets(facts, TABLE, [HOT, Facet("id", "cast(id AS string)")], QUERY)
    totals = {r.facet: r.cnt for r in out.filter(F.col("kind") == "total").collect()}
    assert totals["host"] == totals["id"] == facts.agg(F.sum("weight")).first()[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_series_of_a_hot_host(facts):
    series = ts.classes_over_time(facts, TABLE, QUERY, keys=["host"])
    hot = series.filter("host = 'hot'").agg(F.sum("cnt_ok"), F.sum("cnt_5xx"), F.count("t")).first()
    want = facts.filter("host = 'hot'").agg(F.sum(F.when(F.col("response_status") < 400, F.col("weight"))),
                                            F.sum(F.when(F.col("response_status") >= 500, F.col("weight")))).first()
    assert hot[:2] == want[:] and hot[2] == 288
    assert an.detect(series, ["host"]).filter("host = 'hot'").count() > 0


def test_drill_into_a_hot_minute(facts):
    query = Query(QUERY.range)
    series = ts.classes_over_time(facts, TABLE, query, keys=["host"])
    found = an.detect(series, ["host"]).filter("host = 'hot'")
    out = an.anomaly_rows(facts, TABLE, Facet("status", "cast(response_status AS string)"), query, found, {"host": "host"})
    behind = {r["rank"]: r.cnt for r in out.groupBy("rank").agg(F.sum("cnt").alias("cnt")).collect()}
    hot_bucket = START + timedelta(hours=1)
    first = next(r for r in found.collect() if r.start_time <= hot_bucket <= r.end_time)
    status = {"green": "response_status < 300", "red": "response_status >= 500"}[first.category]
    inside = facts.filter("host = 'hot'").filter(F.col("timestamp").between(
        F.lit(str(first.start_time)).cast("timestamp_ntz"), F.lit(str(first.end_time + timedelta(minutes=9, seconds=59))).cast("timestamp_ntz")))
    assert behind[first["rank"]] == inside.filter(status).agg(F.sum("weight")).first()[0]


def test_nearest_with_most_probes_in_one_block(facts):
    points = facts.filter("response_status = 503").select("host", ts.bucket("timestamp", timedelta(minutes=10)).alias("t")).distinct()
    probes = facts.select("host", F.col("timestamp").alias("at"), "id")
    out = lookups.nearest_points(points, probes, ["host"], timedelta(minutes=10))
    assert out.count() == N and out.select("id").distinct().count() == N


def test_latest_of_a_hot_key_ships_one_row_per_task(facts):
    out = lookups.latest(facts.select("host", "id", "weight"), ["host"], "id")
    assert {r.host: r.id for r in out.collect()}["hot"] == N - 2
    assert shuffled(out)[0] <= 501 * 8


def test_page_of_a_hot_minute(facts):
    page = listing.log_page(facts, TABLE, QUERY, 50)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
    assert page.count() == 50


def test_a_hot_day_spreads_over_files(facts, tmp_path):
    path = str(tmp_path / "facts")
    facts.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_facts(facts, path, sort=("host",))
    finally:
        facts.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = facts.sparkSession.read.parquet(path)
    per_file = stored.groupBy("dt", F.input_file_name().alias("f")).count()
    assert per_file.filter("dt = '2026-01-01'").count() >= 3
    assert stored.count() == N


def test_a_hot_bucket_is_split_when_nothing_can_be_broadcast(facts):
    spark = facts.sparkSession
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, value in tight.items():
        spark.conf.set(k, value)
    try:
        points = facts.filter("response_status = 503").select("host", ts.bucket("timestamp", timedelta(minutes=10)).alias("t")).distinct()
        out = lookups.nearest_points(points, facts.select("host", F.col("timestamp").alias("at"), "id"), ["host"], timedelta(minutes=10))
        assert len(out.collect()) == N
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
