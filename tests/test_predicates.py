import pytest
from pyspark.sql import functions as F

from tidegauge.operators import predicates as p
from tidegauge.plans.dashboards import DELIVERY
from tidegauge.spec import FacetFilter

SCHEMA = "id int, method string, status int, tags array<string>, error string"
DATA = [(1, "GET", 200, ["a", "b"], "x /p"), (2, "GET", 404, ["b"], ""), (3, "POST", 200, [], "y"), (4, "PUT", 503, ["c"], "x /q/r")]


def kept(spark, *filters, known=None):
    df = spark.createDataFrame(DATA, SCHEMA)
    return [r.id for r in df.filter(p.facet_filters(filters, known)).orderBy("id").collect()]


def test_includes_of_one_column_are_alternatives(spark):
    assert kept(spark, FacetFilter("method", "GET"), FacetFilter("method", "PUT")) == [1, 2, 4]


def test_includes_and_excludes_combine(spark):
    assert kept(spark, FacetFilter("method", "GET"), FacetFilter("status", 404, exclude=True)) == [1]
    assert kept(spark, FacetFilter("method", "GET", exclude=True), FacetFilter("method", "PUT", exclude=True)) == [3]


def test_numbers_compare_as_numbers(spark):
    assert kept(spark, FacetFilter("label", "404 x", filter_col="status", filter_value=404)) == [2]


def test_membership(spark):
    assert kept(spark, FacetFilter("tags", "b", op="HAS")) == [1, 2]
    assert kept(spark, FacetFilter("tags", "b", op="HAS", exclude=True)) == [3, 4]


def test_like_keeps_wildcards(spark):
    assert kept(spark, FacetFilter("error", "x /%", op="LIKE")) == [1, 4]
    assert kept(spark, FacetFilter("error", "x /%", op="LIKE", exclude=True)) == [2, 3]


def test_unknown_columns_and_operators_are_dropped(spark):
    assert kept(spark, FacetFilter("method", "GET", op=">"), FacetFilter("status", 200), known={"method"}) == [1, 2, 3, 4]


def test_no_filter_keeps_everything(spark):
    assert kept(spark) == [1, 2, 3, 4]


def test_own_filters_are_ignored():
    filters = (FacetFilter("a", 1), FacetFilter("b", 2))
    assert p.without_own(filters, "a") == (FacetFilter("b", 2),)


def test_grouped_error_filter_is_a_pattern():
    flt = DELIVERY.facets["errors"].filter("failed /...")
    assert (flt.filter_col, flt.filter_value, flt.op) == ("response_headers_x_error", "failed /%", "LIKE")


def test_network_filter_is_a_number():
    assert DELIVERY.facets["asn"].filter("15169 some name").filter_value == 15169


@pytest.mark.parametrize("text,hits", [
    ("0A1b2c3d-0000-4000-8000-00000000ABCD", ["id"]), ("0a1b2c3d", ["message"]), ("", ["id", "message", "none"])])
def test_search(spark, text, hits):
    uuid = "0A1b2c3d-0000-4000-8000-00000000ABCD"
    df = spark.createDataFrame([("id", uuid, ""), ("message", "", f"in 0a1b2c3d {uuid}"), ("none", "", "")], "name string, rid string, msg string")
    assert [r.name for r in df.filter(p.search_matches(text, "msg", "rid")).collect()] == hits


def test_host_text_is_literal(spark):
    df = spark.createDataFrame([("a_b", ""), ("axb", ""), ("", "a_b")], "host string, fwd string")
    assert df.filter(p.host_contains("a_b", ("host", "fwd"))).count() == 2


@pytest.mark.parametrize("text,exact,n", [("o1/r1", True, 1), ("o/r", False, 3), ("r2", False, 1), ("o1/", False, 2), ("", False, 3)])
def test_owner_repo(spark, text, exact, n):
    df = spark.createDataFrame([("o1", "r1"), ("o1", "r2"), ("o2", "r1")], "owner string, repo string")
    assert df.filter(p.owner_repo_matches(text, "owner", "repo", exact)).count() == n


def test_categories(spark):
    df = spark.createDataFrame([(s,) for s in (0, 200, 399, 400, 499, 500, 599)], "response_status int")
    count = {c: df.filter(p.category_matches(c)).count() for c in ("red", "yellow", "green", "other")}
    assert count == {"red": 2, "yellow": 2, "green": 3, "other": 7}


def test_null_never_matches_or_fails(spark):
    df = spark.createDataFrame([(None, None)], "method string, status int")
    assert df.filter(p.facet_filters([FacetFilter("method", "GET")])).count() == 0
    assert df.filter(F.col("method").isNull()).count() == 1
