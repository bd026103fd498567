import json
from dataclasses import replace
from datetime import datetime, timedelta

import xxhash
from pyspark.sql import functions as F

from checks import ingest as ci
from checks import views
from tidegauge.functions import scalars
from tidegauge.functions.entities import ENTITY_PATTERNS, with_entities
from tidegauge.plans.dashboards import APP_LOGS, DELIVERY
from tidegauge.operators import breakdown as bd
from tidegauge.sources import config_dump, normalize, readers, rollup, writers
from tidegauge.sources.schemas import FLAT_HEADERS, NORMALISED, SERVICES, staging_schema
from tidegauge.spec import Query, TimeRange
from tidegauge.streaming import jobs

SF = "/root/testdata/sf0.001"


def values(df):
    return [r[0] for r in df.collect()]


def test_or_zero_casts(spark):
    texts = ["12", " 12", "-5", "12.7", "1e3", "1d", "", None, "99999999999999999999", "n/a", ".5"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert values(df.select(scalars.unsigned_or_zero(F.col("x")))) == [12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert values(df.select(scalars.double_or_zero(F.col("x")))) == [12.0, 0.0, -5.0, 12.7, 1000.0, 0.0, 0.0, 0.0, 1e20, 0.0, 0.5]
    assert values(df.select(F.expr(scalars.unsigned_or_zero_sql("x")))) == values(df.select(scalars.unsigned_or_zero(F.col("x"))))
    assert values(df.select(F.expr(scalars.double_or_zero_sql("x")))) == values(df.select(scalars.double_or_zero(F.col("x"))))


def test_dates(spark):
    texts = {"Wed, 21 Oct 2015 07:28:00 GMT": "2015-10-21 07:28:00", "Wednesday, 21-Oct-15 07:28:00 GMT": "2015-10-21 07:28:00",
             "2015-10-21T07:28:00Z": "2015-10-21 07:28:00", "2015-10-21T09:28:00.500+02:00": "2015-10-21 07:28:00.5",
             "2015-10-21 07:28:00": "2015-10-21 07:28:00", "2015-10-21": "2015-10-21 00:00:00", "soon": scalars.EPOCH, "": scalars.EPOCH}
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert values(df.select(scalars.date_or_epoch(F.col("x")).cast("string"))) == list(texts.values())


def test_nanoseconds_truncate_to_milliseconds(spark):
    ns = [1_700_000_000_123_999_999, 1_700_000_000_000_000_000, 1_700_000_000_999_000_001]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    assert values(df.select(F.unix_micros(scalars.from_epoch_nanos(F.col("n"))))) == [n // 1_000_000 * 1000 for n in ns]


def test_hours_and_days_count_boundaries(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 0, 59), datetime(2026, 1, 1, 1, 1)), (datetime(2026, 1, 1, 23, 59), datetime(2026, 1, 2))],
                               "a timestamp_ntz, b timestamp_ntz")
    out = df.select(scalars.hours_crossed(F.col("a"), F.col("b")), scalars.days_crossed(F.col("a"), F.col("b"))).collect()
    assert [r[:] for r in out] == [(1, 0), (1, 1)]


# --- normalisers ------------------------------------------------------------

def test_all_services_fill_the_same_columns_without_nulls(spark):
    wanted = [n for n in NORMALISED if n not in {f"request_headers_{h}" for h in normalize.EXTRA_REQUEST_HEADERS}
              | {f"response_headers_{h}" for h in normalize.EXTRA_RESPONSE_HEADERS}]
    for service in SERVICES:
        empty = spark.createDataFrame([(1_700_000_000_000,)], "timestamp bigint")
        raw = spark.read.schema(staging_schema(service)).json(empty.select(F.to_json(F.struct("timestamp"))).rdd.map(lambda r: r[0]))
        row = normalize.normalise_service(raw, service).first().asDict()
        assert sorted(row) == sorted(wanted), service
        assert all(v is not None for v in row.values()), service


def test_backend_rules_are_ordered(spark):
    def record(host, kind="", backend=""):
        return json.dumps({"timestamp": 1, "json": {"request": {"host": host}, "platform": {"request_type": kind, "backend_type": backend}}})
    texts = [record("admin.example.page", "media", "aws"), record("admin.example.page", "", "aws"), record("api.example.live"), record("www.example.live"),
             record("x.example.live", "", "aws"), record("x", "", "cloudflare"), record("admin.other.page"), "{}"]
    raw = spark.read.schema(staging_schema("generic")).json(spark.sparkContext.parallelize(texts, 1))
    assert values(normalize.normalise_service(raw, "generic").select("platform_backend_type")) == [
        "Fastly / Image Optimizer", "Fastly / Admin", "Fastly / API", "Fastly / WWW", "Fastly / AWS", "Fastly / Cloudflare", "Fastly / Other", "Fastly / Other"]


def test_the_platform_struct_may_have_another_name(spark):
    text = json.dumps({"timestamp": 1, "json": {"acme": {"rso": "main--s--o", "scope": "x"}}})
    raw = spark.read.schema(staging_schema("config", "acme")).json(spark.sparkContext.parallelize([text], 1))
    row = normalize.normalise_service(raw, "config", "acme").first()
    assert (row.platform_contentbus_prefix, row.platform_request_type) == ("main--s--o", "x")


def test_flat_records_with_bad_headers(spark):
    texts = [json.dumps({"EdgeStartTimestamp": 1_700_000_000_000_000_000, "ClientRequestHost": h, "RequestHeaders": a, "ResponseHeaders": b, "ClientRequestSource": s})
             for h, a, b, s in (("ok", '{"via":"1.1 x","x-hipaa":"y"}', '{"content-length":"12x"}', None), ("bad", "not json", None, "eyeball"),
                                ("store", "{}", "{}", "eyeball"), ("cache", "{}", "{}", "edgeWorkerCacheAPI"), ("a.r2.cloudflarestorage.com", "{}", "{}", ""))]
    raw = spark.read.schema(FLAT_HEADERS).json(spark.sparkContext.parallelize(texts, 1))
    out = {r.request_host: r for r in normalize.normalise_flat(raw, ["store"]).collect()}
    assert set(out) == {"ok", "bad", "a.r2.cloudflarestorage.com"}
    assert (out["ok"].request_headers_via, out["ok"].request_headers_x_hipaa, out["ok"].response_headers_content_length) == ("1.1 x", "y", 0)
    assert out["bad"].request_headers_via == "" and out["a.r2.cloudflarestorage.com"].platform_backend_type == "Cloudflare / R2"


def test_union_has_no_nulls(spark):
    out = ci._normalised(spark, SF)
    assert out.columns == list(NORMALISED)
    nulls = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first().asDict()
    assert {c: n for c, n in nulls.items() if n} == {}


# --- sampling ---------------------------------------------------------------

def test_sampling_by_brute_force(spark):
    df = views.access(spark, SF)
    rate = 7

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    want = {r.event_id for r in df.select("event_id", F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ms"), "cdn_originating_ip").collect()
            if signed(xxhash.xxh64(f"{r.ms}:{r.cdn_originating_ip}".encode(), seed=42).intdigest()) % rate == 0}
    out = rollup.thin_out(df, rate).collect()
    assert {r.event_id for r in out} == want and len(want) > 50
    assert {r.weight for r in out} == {rate}


def test_sample_parts_are_disjoint_and_complete(spark):
    df = views.access(spark, SF).withColumn("sample_hash", rollup.sample_key("event_id"))
    n = df.count()
    half, most = readers.sample(df, 2, 4).count(), readers.sample(df, 4, 4).count()
    assert most == n and abs(half / n - 0.5) < 0.1


# --- entities ---------------------------------------------------------------

def test_entities(spark):
    text = ("see https://a.example.com/x/y?q=1 and 'http://b.org/z' mail me.you+x@mail.example.org from 10.0.0.1 or 1.2.3.4.5 "
            "é9.9.9.9 path /foo/bar/baz.html ref main--site--org x1.2.3.4")
    row = with_entities(spark.createDataFrame([(text,)], "message string")).first()
    assert row.urls == ["https://a.example.com/x/y?q=1", "http://b.org/z"]
    assert row.emails == ["me.you+x@mail.example.org"]
    assert row.ips == ["10.0.0.1", "1.2.3.4", "9.9.9.9"]
    assert "/foo/bar/baz.html" in row.paths and row.refs == ["main--site--org"]
    assert "a.example.com" in row.hostnames and "mail.example.org" in row.hostnames


def test_messages_that_are_no_json(spark):
    df = spark.createDataFrame([(m,) for m in ('{"admin":{"method":"GET","duration":12}}', "{'a': 1}", "text", "", None, "null")], "message string")
    rows = with_entities(df)
    facet = APP_LOGS.facets
    assert values(rows.select(F.expr(facet["admin-method"].dim))) == ["GET", "", "", "", "", ""]
    assert values(rows.select(F.expr(facet["admin-duration"].raw))) == [12.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert all(v == [] for r in rows.select(*ENTITY_PATTERNS).collect() for v in r)


def test_function_names(spark):
    df = spark.createDataFrame([("svc/a/v12",), ("plain",), ("x/",)], "function_name string")
    f = APP_LOGS.facets
    assert [r[:] for r in df.select(F.expr(f["function-name"].dim), F.expr(f["function-version"].dim)).collect()] == [
        ("svc/a", "v12"), ("plain", "plain"), ("x/", "")]


# --- tables -----------------------------------------------------------------

def test_facts_prune_days(spark, tmp_path):
    path = str(tmp_path / "facts")
    writers.write_facts(views.access(spark, SF), path)
    facts = readers.read_facts(spark, path, TimeRange.free(datetime(2024, 1, 3), datetime(2024, 1, 4, 12)))
    plan = facts._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert {r.dt.day for r in facts.select("dt").distinct().collect()} <= {3, 4}


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    df = spark.range(0, 4000, 2).select(F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz").alias("timestamp"),
                                        F.sha1(F.col("id").cast("string")).alias("request_host"))
    absent = spark.range(1).select(F.sha1(F.lit("7"))).first()[0]

    def rows_read(name, **options):
        path = str(tmp_path / name)
        spark.conf.set("parquet.enable.dictionary", "false")
        try:
            writers.write_facts(df, path, **options)
        finally:
            spark.conf.unset("parquet.enable.dictionary")
        found = spark.read.parquet(path).filter(F.col("request_host") == absent)
        assert found.collect() == []
        plan = found._jdf.queryExecution().executedPlan()
        while not plan.nodeName().startswith("Scan"):
            plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().head()
        return plan.metrics().apply("numOutputRows").value()

    assert rows_read("plain") > 0 and rows_read("bloom", bloom=("request_host",)) == 0


def test_loading_a_day_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "facts")
    days = spark.createDataFrame([(datetime(2026, 1, d), "h", d) for d in (1, 2)], "timestamp timestamp_ntz, request_host string, n int")
    writers.write_facts(days, path)
    writers.write_facts(days.filter("n = 2"), path, mode="overwrite", only_days=True)
    assert sorted(values(spark.read.parquet(path).select("n"))) == [1, 2]
    writers.write_facts(days.filter("n = 2"), path, mode="overwrite")
    assert values(spark.read.parquet(path).select("n")) == [2]


def test_export(spark, tmp_path):
    path = str(tmp_path / "tsv")
    df = spark.createDataFrame([("value", "", 5, 3, 1, 1), ("value", 'a "b"', 2, 2, 0, 0), ("total", None, 7, 5, 1, 1)],
                               "kind string, dim string, cnt int, cnt_ok int, cnt_4xx int, cnt_5xx int")
    writers.write_tsv(df.coalesce(1), path)
    text = spark.read.text(path, wholetext=True).first()[0]
    assert text == 'Value\tCount\tOK (2xx/3xx)\t4xx\t5xx\n(empty)\t5\t3\t1\t1\na "b"\t2\t2\t0\t0\n'


def test_nested_rows_with_dotted_names(spark):
    df = spark.createDataFrame([(1, "h", "", None)], "id int, `request.host` string, `request.headers.via` string, `response.status` int")
    assert json.loads(df.select(writers.nested_json(df)).first()[0]) == {"id": 1, "request": {"host": "h"}}


def test_compaction_and_expiry(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, datetime(2026, 1, 1)), ("k", 2, datetime(2026, 1, 20))], "k string, v int, timestamp timestamp_ntz")
    writers.compact_versions(df, ["k"], "v", str(tmp_path / "c"))
    assert values(spark.read.parquet(str(tmp_path / "c")).select("v")) == [2]
    assert writers.expire(df, timedelta(days=14), datetime(2026, 1, 21)).count() == 1


def test_dump_defaults(spark):
    text = json.dumps({"o": {"sites": {"s": {"data": {"version": "x", "content": {"overlay": {"url": "https://json2html.x/", "type": "t"}}}}, "t": {}},
                             "profiles": {"p": {"data": {"features": {"a": 1}, "folders": {}}}}}})
    orgs = config_dump.read_orgs(spark.createDataFrame([(text,)], "orgs string"))
    assert config_dump.org_rows(orgs).count() == 0
    rows = {r.site: r for r in config_dump.site_rows(orgs).collect()}
    assert (rows["s"].version, rows["s"].content_source_overlay_type, rows["s"].features, rows["s"].folders) == (0, "json2html", "{}", False)
    assert rows["t"].created == datetime(1970, 1, 1) and rows["t"].profile == ""
    assert config_dump.profile_rows(orgs).first().features == '{"a":1}'


# --- streaming --------------------------------------------------------------

def access_files(spark, folder, parts=3):
    df = views.access(spark, SF)
    for i in range(parts):
        df.filter(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(folder)
    return df


def test_streamed_rollup_equals_batch_over_several_batches(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    df = access_files(spark, source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    jobs.start_rollup(stream, DELIVERY, ci.FACETS, out, str(tmp_path / "cp"), "edge").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.select(jobs.BATCH).distinct().count() == 3
    assert rows(rollup.merge_rollups(jobs.read_batches(spark, out))) == rows(rollup.minute_rollup(df, DELIVERY, ci.FACETS))


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(10)
    jobs.write_batch(df, 0, out, "edge", "q1")
    for _ in range(2):
        jobs.write_batch(df, 1, out, "edge", "q1")
    assert spark.read.parquet(out).count() == 20


def test_days_of_a_batch_are_replaced_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    days = spark.createDataFrame([(datetime(2026, 1, d), d) for d in (1, 2, 3)], "timestamp timestamp_ntz, n int")
    jobs.write_batch(days, 0, out, "edge", "q1", "timestamp")
    jobs.write_batch(days.filter("n < 3"), 0, out, "edge", "q1", "timestamp")
    stored = jobs.read_batches(spark, out)
    assert stored.count() == 2
    pruned = stored.filter("dt = DATE '2026-01-02'")
    assert values(pruned.select("n")) == [2] and "PartitionFilters: [isnotnull(dt" in pruned._jdf.queryExecution().toString()


def test_json_lines_stream_through_normaliser_to_facts_and_rollup(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    raw = ci.raw_service(spark, SF, "generic").repartition(3)
    raw.write.option("compression", "gzip").json(source)
    stream = readers.stream_json_lines(spark, source, staging_schema("generic"), files_per_batch=1)
    plain = replace(DELIVERY, weight=None)
    facts = str(tmp_path / "facts")
    jobs.start_ingest(stream, lambda b: normalize.normalise_service(b, "generic"), facts, rollup.routes((), ()),
                      str(tmp_path / "cp"), "generic", "delivery", str(tmp_path / "minutes"), plain, ci.FACETS).awaitTermination()
    want = normalize.normalise_service(raw, "generic")
    stored = {t: jobs.read_batches(spark, facts, t) for t in ("delivery", "delivery_errors", "backend")}
    assert stored["delivery"].count() + stored["backend"].count() == want.count() == 1000
    assert stored["delivery_errors"].count() == want.filter("cdn_is_edge AND response_status >= 500").count() > 0
    minutes = rollup.merge_rollups(jobs.read_batches(spark, str(tmp_path / "minutes")))
    assert rows(minutes) == rows(rollup.minute_rollup(want.filter("cdn_is_edge"), plain, ci.FACETS))


def test_restart_continues_where_it_stopped(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = views.access(spark, SF).select("event_id", "client_asn")
    for half in (0, 1):
        df.filter(F.col("event_id") % 2 == half).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        jobs.start_versions(stream, out, cp, "users").awaitTermination()
    assert spark.read.parquet(out).count() == df.count()


def test_streams_do_not_overwrite_each_other(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)

    def run(name, checkpoint):
        stream = spark.readStream.schema("id long").parquet(source)
        jobs.start_versions(stream, out, str(tmp_path / checkpoint), name).awaitTermination()
    run("first", "cp1")
    run("second", "cp2")  # another source into the same table
    assert spark.read.parquet(out).count() == 20
    run("second", "cp3")  # a fresh checkpoint starts at batch 0 again
    assert spark.read.parquet(out).groupBy(jobs.SOURCE).count().collect() and spark.read.parquet(out).count() == 30


def test_expired_days_are_dropped_at_any_depth(spark, tmp_path):
    days = spark.createDataFrame([(datetime(2026, 1, d), d) for d in range(1, 8)], "timestamp timestamp_ntz, n int")
    out = str(tmp_path / "out")
    for batch in (0, 1):
        jobs.write_batch(days, batch, out, "edge", "q1", "timestamp")
    for gone in (["dt=2026-01-01", "dt=2026-01-02"], []):
        assert writers.drop_expired(spark, out, timedelta(days=4), datetime(2026, 1, 7, 12)) == gone
    assert sorted(values(jobs.read_batches(spark, out).select("n"))) == sorted([3, 4, 5, 6, 7] * 2)


def test_windowed_rollup_drops_nothing_in_time(spark, tmp_path):
    source = str(tmp_path / "in")
    df = access_files(spark, source, 1)
    stream = spark.readStream.schema(df.schema).parquet(source).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    query = (jobs.windowed_rollup(stream, DELIVERY, ci.FACETS, timedelta(minutes=1)).writeStream.outputMode("complete")
             .format("memory").queryName("windowed").trigger(availableNow=True).start())
    query.awaitTermination()
    want = rollup.minute_rollup(df, DELIVERY, ci.FACETS).agg(F.sum("cnt")).first()[0]
    assert spark.table("windowed").agg(F.sum("cnt")).first()[0] == want


def test_missing_facet_summary_in_stream_tables(spark):
    facet = DELIVERY.facets["methods"]
    out = bd.breakdown(views.access(spark, SF), DELIVERY, facet, Query(views.MONTH))
    assert "summary_cnt" in out.columns


def test_status_alone_does_not_build_the_record(spark):
    """Spark takes the status out of a record made by the query; text that is no number, or too large, is 0."""
    texts = ["200", " 200", "", None, "-1", "20x", "99999999999", "007", "12\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "timestamp long, t string").repartition(1)
    status, other = F.concat("t", F.lit("")), F.upper("t")
    record = F.struct(F.struct(status.alias("status"), other.alias("body")).alias("response"),
                      F.struct(*[other.alias(c) for c in ("ref", "repo", "owner", "route")]).alias("platform"))
    out = normalize.normalise_service(rows.select("timestamp", record.alias("json")), "admin").select("timestamp", "response_status")
    assert "struct" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.response_status for r in out.orderBy("timestamp").collect()] == [200, 0, 0, 0, 0, 0, 0, 7, 12]
