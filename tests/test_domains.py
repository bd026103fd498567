from datetime import datetime, timedelta

import pytest

from tidegauge.operators import domains

AS_OF = datetime(2026, 1, 10)
SCHEMA = "request_host string, request_headers_x_forwarded_host string, request_headers_x_byo_cdn_type string, timestamp timestamp_ntz"
LIVE = "main--repo--owner.example.live"
PLATFORM = domains.Platform(own_domains=("own.example.com",))


def report(spark, *rows, age=timedelta(days=7)):
    data = [(host, fwd, "akamai", AS_OF - timedelta(hours=h)) for host, fwd, h in rows]
    return domains.domain_report(spark.createDataFrame(data, SCHEMA), PLATFORM, AS_OF, age)


@pytest.mark.parametrize("forwarded,domain", [
    ("WWW.Shop.com:443, edge.net", "www.shop.com"), (" shop.com. , x", "shop.com"), ("shop.co.uk..", "shop.co.uk"),
    ("10.0.0.1", None), ("localhost:3000", None), ("a.workers.dev", None), ("<x>.com", None), ("{x}.com", None), ("x.com/a", None),
    ("x.oast.fun", None), ("own.example.com", None), ("pr.example.reviews", None), ("a.example.page", None), ("shop", None), ("b.com", None), ("", None),
    (LIVE, None), ("-shop.com", None), ("shop.c0m", None)])
def test_which_domains_count(spark, forwarded, domain):
    out = [r.domain for r in report(spark, (LIVE, forwarded, 1)).collect()]
    assert out == ([] if domain is None else [domain])


def test_rate_total_and_age(spark):
    rows = [(LIVE, "shop.com", h) for h in (1, 1, 2, 50)] + [(LIVE, "SHOP.com:443", 3), (LIVE, "shop.com", 200), ("x.other.org", "shop.com", 1)]
    row = report(spark, *rows).first()
    # 50 hours ago to one hour ago are 49 boundaries; five requests in 50 hours.
    assert (row.owner, row.repo, row.cdn_type, row.total, row.req_per_hour, row.age_days) == ("owner", "repo", "akamai", 5, 0.1, 3)


def test_listing_order_and_filter(spark):
    hosts = [f"main--{r}--o.example.live" for r in ("b", "A", "c")]
    out = report(spark, (hosts[0], "bb.com", 1), (hosts[0], "bb.com", 2), (hosts[1], "aa.com", 30), (hosts[2], "cc.com", 1), (hosts[1], "zz.com", 1))
    assert [r.domain for r in domains.domain_listing(out).collect()] == ["bb.com", "aa.com", "cc.com", "zz.com"]
    assert [r.domain for r in domains.domain_listing(out, "repo", True).collect()] == ["aa.com", "zz.com", "bb.com", "cc.com"]
    assert [(r.domain, r.is_new) for r in domains.domain_listing(out, text="AA.C").collect()] == [("aa.com", False)]
