from datetime import datetime, timedelta
from random import Random

from pyspark.sql import functions as F

from checks import views
from tidegauge.functions.json_patch import merge_patch
from tidegauge.operators import configs, listing, lookups
from tidegauge.plans.dashboards import DELIVERY
from tidegauge.spec import TimeRange

T0 = datetime(2026, 1, 1)


def test_latest_takes_the_whole_row(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 3, None, "n"), ("a", 2, "z", "o"), ("b", 1, "q", "p")],
                               "k string, v int, s string, u string")
    assert sorted(r[:] for r in lookups.latest(df, ["k"], "v").collect()) == [("a", 3, None, "n"), ("b", 1, "q", "p")]


def test_latest_with_equal_versions_is_decidable(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(50)], "k string, v int, tie int")
    assert lookups.latest(df.repartition(7), ["k"], ["v", "tie"]).first().tie == 49


def test_site_versions_of_one_file_are_made_in_several_tasks(spark, tmp_path):
    """Customers that one task scans; a row may come twice and keys may be NULL."""
    data = [(i, i % 25) for i in range(500)] + [(7, 7), (None, 3)]
    spark.createDataFrame(data, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = views.site_versions(spark, str(tmp_path))
    assert found.count() == sum(1 + (k or 0) % 3 for k, _ in data if k is not None)
    per_task = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(per_task) < found.count() / 4
    assert lookups.latest(found, ["org", "site"], "_version").count() == 500


def test_request_ids_with_a_hot_id(spark):
    """A third of all rows share one id, another third carries none."""
    data = [("hot" if i % 3 == 0 else "0" if i % 3 == 1 else f"id{i % 50}", T0 + timedelta(seconds=i), i) for i in range(3000)]
    other = spark.createDataFrame(data, "ray_id string, timestamp timestamp_ntz, n int").repartition(8)
    ids = spark.createDataFrame([("hot",)] * 200 + [("0",), ("",), ("id2",), ("nowhere",)], "ray_id string")
    out = lookups.matches_by_request_id(ids, other, ["n"], tie=["n"])
    got = {}
    for r in out.orderBy("ray_id", "match").collect():
        got.setdefault(r.ray_id, []).append(r.n)
    assert got == {"hot": [0, 3, 6, 9, 12], "id2": sorted(i for i in range(3000) if i % 3 == 2 and i % 50 == 2)[:5]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Partial limit below the shuffle, final one above it.
    lines = [line.split("Exchange")[0] + "Exchange" if "Exchange hashpartitioning(ray_id" in line else line for line in plan.splitlines()]
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    assert len(limits) >= 2 and any("Exchange" in line for line in lines[limits[0]:limits[1]])


def test_no_lookup_for_internal_ids(spark):
    df = spark.createDataFrame([("0", T0)], "ray_id string, timestamp timestamp_ntz")
    assert lookups.rows_of_request_id(df, "0", []).count() == 0


def test_nearest_against_brute_force(spark):
    rng = Random(3)
    points = {k: sorted({rng.randrange(0, 200_000) // 10 * 10 for _ in range(n)}) for k, n in (("a", 80), ("b", 3), ("c", 1), ("d", 0))}
    probes = [(i, rng.choice("aaaabcd"), rng.randrange(-20_000, 220_000)) for i in range(2000)]
    p = spark.createDataFrame([(k, T0 + timedelta(seconds=s)) for k, v in points.items() for s in v], "key string, t timestamp_ntz")
    q = spark.createDataFrame([(i, k, T0 + timedelta(seconds=s)) for i, k, s in probes], "id int, key string, at timestamp_ntz")
    out = {r.id: r.nearest for r in lookups.nearest_points(p, q, ["key"], timedelta(seconds=10)).collect()}
    assert len(out) == len(probes)
    for i, k, s in probes:
        best = min(points[k], key=lambda x: (abs(x - s), x), default=None)
        assert out[i] == (None if best is None else T0 + timedelta(seconds=best))


def test_releases_latest_version_within_closed_range(spark):
    rows = [(T0, "r", "1", 1), (T0 + timedelta(days=9), "r", "1", 2), (T0 + timedelta(hours=2), "r", "2", 1), (T0 + timedelta(hours=3), "certs", "1", 1)]
    df = spark.createDataFrame([(t, r, g, "", "", n) for t, r, g, n in rows], "published timestamp_ntz, repo string, tag string, url string, body string, _version long")
    rng = TimeRange.free(T0, T0 + timedelta(hours=3))
    series = spark.createDataFrame([(T0 + timedelta(hours=2), 5)], "t timestamp_ntz, cnt_ok bigint")
    out = {(r.repo, r.tag): (r.cnt_ok, round(r.position, 3), r.maintenance) for r in lookups.release_overlay(series, df, rng, ["certs"]).collect()}
    assert out == {("r", "2"): (5, 0.667, False), ("certs", "1"): (None, 1.0, True)}


# --- configurations ---------------------------------------------------------

def test_merge_patch_rules(spark):
    cases = [  # base, patch, merged
        ('{"a":1}', '{"b":2}', '{"a":1,"b":2}'), ('{"a":1}', '{"a":null}', "{}"), ("", '{"a":null,"b":1}', '{"b":1}'),
        ('{"a":{"x":1,"y":2}}', '{"a":{"x":null,"z":3}}', '{"a":{"y":2,"z":3}}'), ('{"a":[1,2]}', '{"a":[3]}', '{"a":[3]}'),
        ('{"a":"ü"}', "{}", '{"a":"ü"}'), ('{"a":1}', "", '{"a":1}'), ("{}", "", ""), (None, None, ""), ('{"a":{"b":1}}', '{"a":5}', '{"a":5}'),
        ('{"a":5}', '{"a":{"b":{"c":null}}}', '{"a":{"b":{}}}'),
    ]
    df = spark.createDataFrame(cases, "base string, patch string, want string")
    for r in df.withColumn("got", merge_patch(F.col("base"), F.col("patch"))).collect():
        assert r.got == r.want, r


def sites(spark, *rows):
    names = ["org", "site", "profile", "version", "created", "last_modified", *configs.INHERITED_TEXT, "folders", "features", "limits"]
    kinds = {"version": "bigint", "created": "timestamp", "last_modified": "timestamp", "folders": "boolean"}
    base = {n: 1 if n == "version" else T0 if n in ("created", "last_modified") else False if n == "folders" else "" for n in names}
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def test_resolution(spark):
    s = sites(spark, {"org": "o", "site": "a", "code_owner": "mine"}, {"org": "o", "site": "b", "profile": "p", "features": '{"x":1}'},
              {"org": "q", "site": "c", "folders": True})
    p = sites(spark, {"org": "o", "profile": "default", "code_owner": "base", "code_repo": "r"},
              {"org": "o", "profile": "p", "code_owner": "pp", "features": '{"x":0,"y":2}', "folders": True}).drop("site")
    out = {r.site: r for r in configs.resolve(s, p).collect()}
    assert (out["a"].code_owner, out["a"].code_repo, out["a"].folders) == ("mine", "r", False)
    assert (out["b"].code_owner, out["b"].features, out["b"].folders) == ("pp", '{"x":1,"y":2}', True)
    assert (out["c"].code_owner, out["c"].folders, out["c"].limits) == ("", True, "")
    inherited = {r.site: set(r.inherited) for r in configs.compare_with_resolved(s, configs.resolve(s, p)).collect()}
    assert inherited == {"a": {"code_repo"}, "b": {"code_owner", "folders", "features"}, "c": set()}


def test_config_filters(spark):
    df = sites(spark, {"org": "Org", "site": "Web", "cdn_prod_type": "fastly", "cdn_prod_host": "h"}, {"org": "other", "site": "web", "content_bus_id": "ORGX"})
    assert df.filter(configs.text_matches("org / we")).count() == 1
    assert df.filter(configs.text_matches("ORG")).count() == 2
    assert df.filter(configs.types_match({"cdn": "(none)"})).count() == 1
    assert df.filter(configs.presence_matches(["cdn_host", "cdn_type"])).count() == 1
    assert df.filter(configs.presence_matches([])).count() == 2
    assert configs.stats(df.limit(0)).first().pct_folders == 0


def test_code_source_types(spark):
    urls = ["https://github.com/a/b", "https://WWW.github.com/a", "https://git.x.org/a", "", "not a url", "github.com/a"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    out = [r[0] for r in df.select(configs.code_source_type(F.col("u"), F.lit("d"))).collect()]
    assert out == ["github", "github", "byogit", "d", "d", "d"]


# --- suggestions ------------------------------------------------------------

def test_merged_hosts(spark):
    hosts = spark.createDataFrame([("b",), ("",)], "host string")
    forwarded = spark.createDataFrame([("c , a",), ("b,,",)], "host string")
    assert [r.host for r in listing.merged_hosts(hosts, forwarded).collect()] == ["a", "b", "c"]


def test_suggestions_rank(spark):
    names = spark.createDataFrame([(x,) for x in ("xacme", "acme/one", "Acme", "acmeland", "other/acme", "zzz")], "owner_repo string")
    assert [r.owner_repo for r in listing.ranked_suggestions(names, "ACME").collect()] == ["Acme", "acmeland", "acme/one", "other/acme", "xacme"]
    assert listing.ranked_suggestions(names, "").count() == 0


def test_short_patterns_find_nothing(spark):
    from checks import views
    from checks.traffic import MONTH
    df = views.access(spark, "/root/testdata/sf0.001")
    assert listing.values_containing(df, DELIVERY, DELIVERY.facets["hosts"], MONTH, "m").count() == 0


def test_pages_by_offset_and_by_key_agree(spark):
    from dataclasses import replace
    from checks import views
    from checks.traffic import MONTH
    df, table = views.access(spark, "/root/testdata/sf0.001"), replace(DELIVERY, id="event_id")
    first = listing.log_page(df, table, MONTH, 100).collect()
    second = listing.log_page(df, table, MONTH, 100, offset=100).select("event_id").collect()
    last = first[-1]
    by_key = listing.log_page(df, table, MONTH, 100, after=(last.timestamp, last.event_id)).select("event_id").collect()
    assert second == by_key and not {r.event_id for r in first} & {r.event_id for r in second}


def test_pages_of_day_partitioned_facts(spark, tmp_path):
    from dataclasses import replace
    from checks import views
    from checks.traffic import MONTH
    from tidegauge.sources.writers import write_facts
    df = views.access(spark, "/root/testdata/sf0.001")
    write_facts(df, str(tmp_path / "facts"))
    stored = spark.read.parquet(str(tmp_path / "facts"))
    table = replace(DELIVERY, id="event_id")
    for offset in (0, 40):
        page = listing.log_page(stored, replace(table, day="dt"), MONTH, 30, offset)
        assert [r.event_id for r in page.collect()] == [r.event_id for r in listing.log_page(df, table, MONTH, 30, offset).collect()]
    scans = [line for line in page._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters: [isnotnull(dt" in line]
    assert len(scans) >= 2
    assert listing.log_page(stored.filter("false"), replace(table, day="dt"), MONTH, 30).count() == 0
