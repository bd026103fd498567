"""Log pages whose first minute comes from counts per minute."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import listing
from tidegauge.sources.writers import write_facts
from tidegauge.spec import FacetFilter, LogTable, Query, TimeRange

TABLE = LogTable("t", day="dt", id="id", hosts=("request_host",), owner="request_host", repo="request_host")
START = datetime(2024, 1, 1)
QUERY = Query(TimeRange.free(START, START + timedelta(days=9, hours=23)))


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """Ten days of rows, a crowd of equal times among them."""
    path = str(tmp_path_factory.mktemp("pages"))
    rows = spark.range(6000).selectExpr("id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(id * 139 AS double)) AS timestamp", "concat('h', id % 5) AS request_host")
    crowd = spark.range(6000, 6400).selectExpr("id", "timestamp_ntz '2024-01-07 12:30:00' AS timestamp", "'crowd' AS request_host")
    write_facts(rows.union(crowd), path)
    return spark.read.parquet(path)


def files_read(spark, df):
    """Files that the scan of the wide rows opened."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value()


def test_pages_equal_those_without_counts(facts):
    counts = listing.minute_rows(facts, TABLE)
    for more in ({}, {"offset": 40}, {"offset": 1500}, {"offset": 6380}, {"offset": 9000}, {"after": (datetime(2024, 1, 7, 12, 30), 6200)},
                 {"after": (datetime(2024, 1, 7, 12, 30), 6010), "offset": 30}, {"after": (datetime(2024, 1, 1, 0, 10), 3)}, {"after": (datetime(2023, 1, 1), 3)}):
        for page in (7, 60):
            want = listing.log_page(facts, TABLE, QUERY, page, **more).collect()
            assert listing.log_page(facts, TABLE, QUERY, page, counts=counts, **more).collect() == want
            # Counts that lag behind only make the bound older.
            late = counts.filter(F.col("minute") < F.lit(datetime(2024, 1, 7, 12, 0)))
            assert listing.log_page(facts, TABLE, QUERY, page, counts=late, **more).collect() == want


def test_filters_leave_the_counts_aside(facts):
    counts = listing.minute_rows(facts, TABLE)
    for query in (Query(QUERY.range, host="h3"), Query(QUERY.range, where="id % 7 = 0"), Query(QUERY.range, filters=(FacetFilter("request_host", "h1"),))):
        assert listing.log_page(facts, TABLE, query, 20, counts=counts).collect() == listing.log_page(facts, TABLE, query, 20).collect()


def test_only_days_of_the_page_are_read(spark, facts):
    """Both passes open the last day's files alone; without counts the narrow pass opens those of the whole range."""
    counts = listing.minute_rows(facts, TABLE)
    last = len(facts.filter("dt = '2024-01-10'").select(F.input_file_name()).distinct().collect())
    all_days = len(facts.select(F.input_file_name()).distinct().collect())
    bounded = listing.log_page(facts, TABLE, QUERY, 50, offset=100, counts=counts)
    assert files_read(spark, bounded) == last < all_days
    begins = listing._page_begins(counts, QUERY.range, 150, None)
    assert begins.date() == datetime(2024, 1, 10).date()
    narrow = facts.filter((F.col("timestamp") >= F.lit(begins)) & (F.col("dt") >= F.lit(begins.date()))).select("timestamp")
    assert files_read(spark, narrow) == last and narrow.count() >= 150
