"""Snapshots of latest versions: merged without moving them, late and equal versions, NULL keys."""

import uuid

import pytest

from tidegauge.operators.lookups import latest
from tidegauge.sources.snapshots import advance_snapshot, open_snapshot, read_latest, write_snapshot

SCHEMA = "k string, j int, v int, w int, x string"
KEYS, VERSION = ["k", "j"], ["v", "w"]


@pytest.fixture
def named(spark, tmp_path):
    """Fresh table names with their folders, dropped at the end."""
    made = []

    def make():
        name = f"snapshot_{uuid.uuid4().hex}"
        made.append(name)
        return name, f"{tmp_path}/{name}"
    yield make
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


OLD = [("a", 1, 1, 1, "a1"), ("a", 1, 2, 1, "a2"), ("b", 1, 5, 1, "b5"), ("c", 1, 1, 1, "c1"), ("d", 2, 3, 3, "d3"), (None, 1, 1, 1, "n1"), ("e", None, 1, 1, "e1")]
TAIL = [("a", 1, 2, 2, "a2b"), ("b", 1, 4, 9, "late"), ("d", 2, 3, 3, "d3"), ("f", 1, 1, 1, "f1"), ("f", 1, 2, 1, "f2"), (None, 1, 2, 1, "n2"), ("e", None, 0, 1, "e0")]


def test_snapshot_and_tail_equal_all_history(spark, rows, named):
    table, path = named()
    write_snapshot(frame(spark, OLD), table, path, KEYS, VERSION, 4)
    assert rows(spark.table(table)) == rows(latest(frame(spark, OLD), KEYS, VERSION))
    for tail in (TAIL, TAIL[:1], [], OLD):
        merged = read_latest(spark, table, frame(spark, tail), KEYS, VERSION)
        assert rows(merged) == rows(latest(frame(spark, OLD + tail), KEYS, VERSION))


def test_snapshot_side_is_not_shuffled(spark, named):
    table, path = named()
    write_snapshot(frame(spark, [(f"k{i}", i % 3, 1, 1, "x") for i in range(200)]), table, path, KEYS, VERSION, 6)
    merged = read_latest(spark, table, frame(spark, TAIL), KEYS, VERSION)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    join = plan[plan.index("SortMergeJoin"):]
    left = join[:join.index("FileScan")]  # from the join down to the snapshot's scan, its first input
    assert "Exchange" not in left and "Bucketed: true" in join
    assert "hashpartitioning" in join[join.index("FileScan"):]  # the tail is dealt into the snapshot's buckets


def test_advancing_and_naming_again(spark, rows, named):
    first, path1 = named()
    second, path2 = named()
    write_snapshot(frame(spark, OLD), first, path1, KEYS, VERSION, 4)
    advance_snapshot(spark, first, frame(spark, TAIL), KEYS, VERSION, second, path2, 4)
    want = rows(latest(frame(spark, OLD + TAIL), KEYS, VERSION))
    assert rows(spark.table(second)) == want
    spark.sql(f"DROP TABLE {second}")  # its files stay, as their place was given
    open_snapshot(spark, second, path2, SCHEMA, KEYS, 4)
    assert rows(spark.table(second)) == want
    assert rows(read_latest(spark, second, frame(spark, OLD), KEYS, VERSION)) == want
