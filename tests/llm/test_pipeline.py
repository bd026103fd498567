import importlib
import sys

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.test_simhash import brute_fingerprint, brute_links, classes, signed
from tests.llm.test_decontaminate import brute as brute_contaminated
from tests.llm.test_tokens import check_packed
from tidegauge.llm.pseudonyms import KEY, replacer


def test_stages_against_plain_versions(spark, prose):
    """Every stage on the output of the one before, against a version without Spark.

    On sf0.01, as the eleven abusive labels of sf0.001 are fewer than abuse is learned from.
    """
    source = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{source}/documents.parquet"), [tuple(r) for r in spark.read.parquet(f"{source}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{source}/labels.parquet").collect()}
    outputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outputs.append(corpus_pipeline.written(stage(spark, outputs[-1], source), "stage"))
    assert all(o.columns == docs.columns for o in outputs[:-1])
    texts = [{r.doc_id: r.text for r in o.select("doc_id", "text").collect()} for o in outputs[:-1]]
    wrong = [d for d, r in labels.items() if (d in texts[1]) != (r.quality == 1 and r.toxic == 0)]
    assert len(wrong) <= 0.1 * len(labels)
    fps = {d: signed(brute_fingerprint(t)) for d, t in texts[1].items()}
    roots = classes(sorted(set(fps.values())), brute_links(sorted(set(fps.values()))))
    least = {}
    for d, f in fps.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    assert set(texts[2]) == set(least.values())
    assert set(texts[3]) == set(texts[2]) - {d for d, _ in brute_contaminated(texts[2].items(), benchmark)}
    replace = replacer(KEY)
    assert texts[4] == {d: replace(t)[0] for d, t in texts[3].items()}
    check_packed(outputs[-1].collect(), list(texts[4].items()))


def test_registered_and_optional(monkeypatch):
    names = queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and "pipeline" not in oracle_sql()
    for module in [m for m in sys.modules if m.startswith(("tidegauge.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, module)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "tidegauge.llm":
                raise ModuleNotFoundError(name=name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    monkeypatch.delattr(importlib.import_module("tidegauge"), "llm", raising=False)
    assert not any(q.startswith("op") or q == "pipeline" for q in queries()) and len(queries()) > 150


@pytest.mark.parametrize("name", ["op1_decontamination", "op9_chat_quotations", "op11_collocations", "op13_exact_dedup"])
def test_against_sql(spark, name):
    import glob
    import os

    import duckdb

    from tools.check_oracle import rows as comparable
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, result = queries()[name](spark, "/root/testdata/sf0.001"), con.execute(oracle_sql()[name])
    assert comparable(df.columns, df.collect()) == comparable([d[0] for d in result.description], result.fetchall())
