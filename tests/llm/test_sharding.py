import zlib

from tidegauge.llm.sharding import shard


def test_groups_balance_and_slots(spark, prose):
    rows = [(i, prose(i, 20 + i % 150)) for i in range(3000)] + [(5000 + i, prose(7, 40)) for i in range(30)] + [(9000, None), (9001, ""), (9002, None), (9000, None)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, shard string, grp int")
    out = shard(docs, 6, 32).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    texts, at, slots, sizes = {}, {}, {}, {}
    for i, t in rows:
        texts[i] = t
    for r in out:
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in at.values()) and set(sizes) == set(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.03 * min(sizes.values())


def test_a_group_above_a_shard_is_cut(spark, prose):
    rows = [(i, "hot " * 50) for i in range(900)] + [(2000 + i, prose(i, 30)) for i in range(900)]
    sizes = {}
    for r in shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, 32).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) < 1.2 * min(sizes.values())


def test_no_rows(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
