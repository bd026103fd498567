"""Ingest with rates of its own per target, batches without rows, the compaction ledger, sampled layouts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import readers, rollup, writers
from tidegauge.streaming import jobs
from tidegauge.streaming.live import LiveTable

SCHEMA = "id bigint, timestamp timestamp_ntz, request_host string, weight bigint"


def rules():
    return {"all": F.lit(True), "odd": F.col("id") % 2 == 1}


def stream_of(spark, path):
    return spark.readStream.schema("id bigint, timestamp timestamp_ntz, request_host string").json(path)


def put(spark, path, ids, day=1):
    rows = [(i, f"2024-01-{day:02d}T0{i % 10}:00:00", f"h{i % 3}") for i in ids]
    spark.createDataFrame(rows, "id bigint, timestamp string, request_host string").coalesce(1).write.mode("append").json(path)


def ingest(spark, tmp_path, rates=None, name="s"):
    jobs.start_ingest(stream_of(spark, f"{tmp_path}/in"), lambda b: b.withColumn("weight", F.lit(1).cast("long")), f"{tmp_path}/t/batches", rules(),
                      f"{tmp_path}/ck-{name}", name, rates=rates, key=F.col("id")).awaitTermination()


def test_every_target_has_its_rate(spark, tmp_path):
    put(spark, f"{tmp_path}/in", range(100))
    ingest(spark, tmp_path, {"all": 10})
    rows = jobs.read_batches(spark, f"{tmp_path}/t/batches", "all").collect()
    assert sorted(r.id for r in rows) == list(range(0, 100, 10)) and {r.weight for r in rows} == {10}
    odd = jobs.read_batches(spark, f"{tmp_path}/t/batches", "odd").collect()
    assert sorted(r.id for r in odd) == list(range(1, 100, 2)) and {r.weight for r in odd} == {1}
    assert sum(r.weight for r in rows) == 100


def test_rates_are_asked_anew_for_each_batch(spark, tmp_path):
    rates = {"all": 2}
    for day, rate in ((1, 2), (2, 5)):
        rates["all"] = rate
        put(spark, f"{tmp_path}/in", range(100 * day, 100 * day + 20), day)
        ingest(spark, tmp_path, lambda: dict(rates))
    got = {(r.id, r.weight) for r in jobs.read_batches(spark, f"{tmp_path}/t/batches", "all").collect()}
    assert got == {(i, 2) for i in range(100, 120, 2)} | {(i, 5) for i in range(200, 220, 5)}


def test_wrong_rates_are_refused(spark):
    rows = spark.range(3).withColumn("weight", F.lit(1))
    for rates in ({"none": 2}, {"all": 0}):
        with pytest.raises(ValueError):
            jobs.routed(rows, rules(), rates, F.col("id"))


def test_batches_without_rows_do_no_harm(spark, tmp_path):
    """A batch that no rule meets, an empty one, and a restart that goes on after both."""
    from tidegauge.plans.dashboards import DELIVERY
    put(spark, f"{tmp_path}/in", range(6))

    def run(name, targets, condition):
        stream = stream_of(spark, f"{tmp_path}/in").filter(condition)
        jobs.start_ingest(stream, lambda b: b.selectExpr("*", "1L AS weight", "200 AS response_status"), f"{tmp_path}/t/batches", targets, f"{tmp_path}/ck-{name}",
                          name, "all", f"{tmp_path}/rollup", DELIVERY, {"host": "request_host"}).awaitTermination()
    run("unmet", {"all": F.lit(False)}, "true")
    run("empty", rules(), "id < 0")
    stored = SCHEMA + ", response_status int"
    assert jobs.read_batches(spark, f"{tmp_path}/t/batches", schema=stored).count() == 0
    put(spark, f"{tmp_path}/in", [6, 7])
    run("unmet", {"all": F.col("id") > 6}, "true")
    assert [r.id for r in jobs.read_batches(spark, f"{tmp_path}/t/batches", "all").collect()] == [7]
    assert rollup.merge_rollups(jobs.read_batches(spark, f"{tmp_path}/rollup")).select("dim", "cnt").collect() == [("h1", 1)]


def ids(spark, table):
    return sorted(r.id for r in table.read(spark).collect())


def test_every_row_once_before_during_and_after_compactions(spark, tmp_path, monkeypatch):
    table = LiveTable(f"{tmp_path}/t", SCHEMA, target="all")
    assert ids(spark, table) == [] and table.compact(spark, [date(2024, 1, 1)], "none") == []
    put(spark, f"{tmp_path}/in", range(10))
    put(spark, f"{tmp_path}/in", range(10, 14), day=2)
    ingest(spark, tmp_path)
    assert ids(spark, table) == list(range(14))
    # It dies before the ledger is written: its rows do not exist for readers, and it may run again.
    import tidegauge.streaming.live as live
    real = live.write_facts

    def dies(*args, **more):
        real(*args, **more)
        raise RuntimeError("lost")
    monkeypatch.setattr(live, "write_facts", dies)
    with pytest.raises(RuntimeError):
        table.compact(spark, [date(2024, 1, 1)], "first")
    monkeypatch.setattr(live, "write_facts", real)
    assert ids(spark, table) == list(range(14))
    covered = table.compact(spark, [date(2024, 1, 1)], "first")
    assert len(covered) == 1 and table.compact(spark, [date(2024, 1, 1)], "first") == []
    assert ids(spark, table) == list(range(14))
    # Late rows of a compacted day, and of another stream.
    put(spark, f"{tmp_path}/in", [20, 21])
    ingest(spark, tmp_path)
    put(spark, f"{tmp_path}/in2", [30])
    jobs.start_ingest(stream_of(spark, f"{tmp_path}/in2"), lambda b: b.withColumn("weight", F.lit(1).cast("long")), f"{tmp_path}/t/batches", rules(),
                      f"{tmp_path}/ck-other", "other").awaitTermination()
    everything = [*range(14), 20, 21, 30]
    assert ids(spark, table) == everything
    assert len(table.compact(spark, [date(2024, 1, 1)], "second")) == 3  # the first compaction and two late batches
    assert table.compact(spark, [date(2024, 1, 1)], "third") == []  # compact already
    assert ids(spark, table) == everything
    gone = table.drop_covered(spark)
    assert len(gone) == 4 and ids(spark, table) == everything and table.drop_covered(spark) == []
    # What a reader opens: one compacted day and the other day's batch; covered folders are not listed.
    assert {f.rsplit("/", 1)[1] for f in table.folders(spark)} == {"dt=2024-01-01", "dt=2024-01-02"} and len(table.folders(spark)) == 2


def test_batches_that_have_not_ended_are_left_alone(spark, tmp_path):
    table = LiveTable(f"{tmp_path}/t", SCHEMA, target="all")
    put(spark, f"{tmp_path}/in", range(4))
    ingest(spark, tmp_path)
    import glob
    import os
    for marker in glob.glob(f"{tmp_path}/t/batches/*/*/*/_SUCCESS"):
        os.remove(marker)
    assert table.compact(spark, [date(2024, 1, 1)], "c") == []


def test_a_sample_reads_a_sample(spark, tmp_path):
    """Files and rows read fall with the share; samples are nested and exact at every share."""
    rows = spark.range(20_000).selectExpr("id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS timestamp", "concat('h', id % 7) AS request_host")
    writers.write_sampled(rows, f"{tmp_path}/s", F.xxhash64("id"))
    table = spark.read.parquet(f"{tmp_path}/s")
    points = {r.id: r.sample_point for r in table.collect()}
    last, files = set(), []
    for part, of in ((1, 100), (1, 16), (1, 5), (1, 2), (1, 1)):
        got = readers.sample_pruned(table, part, of)
        found = {r.id for r in got.collect()}
        assert found == {i for i, p in points.items() if p * of < part << 20} and last <= found
        assert abs(len(found) - 20_000 * part / of) < 6 * (20_000 * part / of) ** 0.5 + 1
        scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
        files.append(scan.metrics().get("numFiles").get().value() if scan.metrics().contains("numFiles") else None)
        last = found
    assert got.columns == ["id", "timestamp", "request_host", "dt"]
    buckets = [readers.sample_pruned(table, p, o).select("id").inputFiles() for p, o in ((1, 100), (1, 1))]
    assert len(buckets[0]) >= 1
    assert "sample_bucket" in readers.sample_pruned(table, 1, 100)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert files[0] is None or files[0] * 8 < files[-1]
    with pytest.raises(ValueError):
        readers.sample_pruned(table, 2, 1)
