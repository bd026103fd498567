from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_skew import shuffled
from tidegauge.operators import predicates as p
from tidegauge.operators import timeseries as ts
from tidegauge.plans.dashboards import DELIVERY
from tidegauge.spec import RANGE_PRESETS, LogTable, Query, TimeRange

NOW = datetime(2026, 1, 20, 12, 34, 56)


def clock(text):
    h, m, s = (float(x) for x in text.split(":"))
    return datetime(2026, 1, 20) + timedelta(hours=h, minutes=m, seconds=s)


def test_hour_preset_bounds():
    rng = TimeRange.preset("1h", NOW)
    assert (rng.first_minute, rng.last_minute) == (clock("11:34:0"), clock("12:34:0"))
    assert (rng.fill_from, rng.fill_to) == (clock("11:34:0"), clock("12:34:50"))


def test_three_days_use_wider_buckets_than_seven():
    assert RANGE_PRESETS["3d"][1] == timedelta(minutes=30)
    assert RANGE_PRESETS["7d"][1] == timedelta(minutes=10)


@pytest.mark.parametrize("minutes,step", [(15, 5), (16, 10), (60, 10), (61, 60), (720, 60), (721, 300), (1440, 300), (1441, 600)])
def test_free_range_steps(minutes, step):
    assert TimeRange.free(NOW, NOW + timedelta(minutes=minutes)).step == timedelta(seconds=step)


def test_last_minute_is_included_whole(spark):
    times = ["11:33:59.999", "11:34:0", "12:34:0", "12:34:59.999", "12:35:0"]
    df = spark.createDataFrame([(t, clock(t)) for t in times], "name string, timestamp timestamp_ntz")
    kept = df.filter(p.in_range(df, TimeRange.preset("1h", NOW))).collect()
    assert [r.name for r in kept] == times[1:4]


def test_time_predicate_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = spark.range(10).select(F.lit(NOW).cast("timestamp_ntz").alias("timestamp"), F.lit(NOW.date()).alias("dt"), "id")
    df.write.partitionBy("dt").parquet(path)
    facts = spark.read.parquet(path)
    plan = facts.filter(p.in_range(facts, TimeRange.preset("1h", NOW), day="dt"))._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(timestamp" in scan and "LessThan(timestamp" in scan
    assert "PartitionFilters: [isnotnull(dt" in scan


@pytest.mark.parametrize("start,end,low,high", [
    ("14:34:15", "15:26:37", "14:34:0", "15:27:0"),
    ("12:0:10", "12:1:20", "11:59:0", "12:3:0"),
    ("15:26:37", "14:34:15", "14:34:0", "15:27:0"),
    ("12:0:0", "12:0:0", "11:59:0", "12:2:0"),
    ("12:0:0", "12:3:0", "12:0:0", "12:3:0"),
])
def test_ranges_snap_to_minutes(spark, start, end, low, high):
    df = spark.createDataFrame([(clock(start), clock(end))], "start timestamp_ntz, end timestamp_ntz")
    assert tuple(ts.snap_ranges(df).first()) == (clock(low), clock(high))


TABLE = LogTable("t", hosts=())


def traffic(spark, points):
    return spark.createDataFrame([(clock(t), s, k) for t, s, k in points],
                                 "timestamp timestamp_ntz, response_status int, host string")


def test_gap_fill_keeps_data_after_the_last_generated_bucket(spark):
    df = traffic(spark, [("11:40:3", 200, "a"), ("12:34:55", 503, "a")])
    out = {r.t: r for r in ts.classes_over_time(df, TABLE, Query(TimeRange.preset("1h", NOW))).collect()}
    # 365 generated buckets up to 12:34:40, plus the data bucket beyond.
    assert len(out) == 366 and max(out) == clock("12:34:50")
    assert clock("12:34:40") in out
    assert out[clock("12:34:50")].cnt_5xx == 1 and out[clock("11:40:0")].cnt_ok == 1
    assert sum(r.cnt_ok + r.cnt_4xx + r.cnt_5xx for r in out.values()) == 2


def test_gap_fill_by_key_equals_gap_fill_of_each_key(spark, rows):
    points = [("11:40:3", 200, "a"), ("11:40:4", 404, "a"), ("12:34:55", 503, "a"), ("11:34:0", 200, "b"), ("12:0:0", 200, "c")]
    df, query = traffic(spark, points), Query(TimeRange.preset("1h", NOW))
    keyed = ts.classes_over_time(df, TABLE, query, keys=["host"])
    for host in "abc":
        single = ts.classes_over_time(df.filter(F.col("host") == host), TABLE, query)
        assert rows(keyed.filter(F.col("host") == host).drop("host"), "t", *ts.CLASSES) == rows(single, "t", *ts.CLASSES)


def test_no_data_gives_zero_rows(spark):
    out = ts.classes_over_time(traffic(spark, []), TABLE, Query(TimeRange.preset("15m", NOW)))
    assert out.agg(F.sum("cnt_ok"), F.count("t")).first()[:] == (0, 191)


def test_chart_limit_is_a_multiple_of_four_and_at_least_four(spark):
    def series(*counts):
        return spark.createDataFrame([(NOW, c, 0, 0) for c in counts], "t timestamp, cnt_ok bigint, cnt_4xx bigint, cnt_5xx bigint")
    assert ts.chart_total(series(1, 9)).first()[:] == (10, 12)
    assert ts.chart_total(series(0)).first()[:] == (0, 4)


def test_last_fifth(spark):
    points = [(clock(f"10:{m}:0"), 1, 0, 0) for m in range(10)]
    series = spark.createDataFrame(points, "t timestamp_ntz, cnt_ok bigint, cnt_4xx bigint, cnt_5xx bigint")
    assert ts.last_fifth(series).first()[:] == (clock("10:8:0"), clock("10:9:0"))
    assert ts.last_fifth(series.limit(1)).count() == 0


def test_range_counters_against_brute_force(spark):
    start = datetime(2026, 1, 1)
    stamps = [start + timedelta(minutes=(i * 7919) % 9000, seconds=i % 60) for i in range(700)]
    facts = spark.createDataFrame([(t, 200 if i % 3 else 500, i % 5 + 1) for i, t in enumerate(stamps)],
                                  "timestamp timestamp_ntz, response_status int, weight bigint")
    spans = [(i, start + timedelta(minutes=(i * 37) % 5000), start + timedelta(minutes=(i * 37) % 5000 + 3 + (i * i * 13) % 4000)) for i in range(60)]
    ranges = spark.createDataFrame(spans, "id int, start timestamp_ntz, end timestamp_ntz")
    out = {r.id: (r.cnt, r.cnt_5xx) for r in ts.counters_in_ranges(facts, DELIVERY, ranges, ["id"]).collect()}
    for i, a, b in spans:
        inside = [(n % 5 + 1, n % 3 == 0) for n, t in enumerate(stamps) if a <= t < b]
        assert out[i] == (sum(w for w, _ in inside), sum(w for w, bad in inside if bad))


def test_range_counters_of_long_ranges_without_times_and_of_repeated_keys(spark):
    """Two rows per range, however long; rows and ranges without a time count nowhere, a key's ranges add up."""
    start = datetime(2026, 1, 1)
    facts = spark.createDataFrame([(None, 200, 50)] + [(start + timedelta(minutes=i), 200, 1) for i in (0, 1, 1439, 1440, 3000)],
                                  "timestamp timestamp_ntz, response_status int, weight bigint")
    spans = [(1, datetime(1700, 1, 1), datetime(2400, 1, 1)), (2, start, start + timedelta(minutes=1439)), (2, start + timedelta(days=1), start + timedelta(days=5)),
             (3, datetime(2030, 1, 1), datetime(2031, 1, 1)), (4, None, None), (None, start, start + timedelta(minutes=1))]
    out = ts.counters_in_ranges(facts, DELIVERY, spark.createDataFrame(spans, "id int, start timestamp_ntz, end timestamp_ntz"), ["id"])
    assert sorted((str(r.id), r.cnt, r.cnt_ok, r.cnt_5xx) for r in out.collect()) == [("1", 5, 5, 0), ("2", 4, 4, 0), ("3", 0, 0, 0), ("None", 1, 1, 0)]
    assert shuffled(out)[0] <= 2 * len(spans)
