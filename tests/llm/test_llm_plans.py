"""Shapes of the physical plans of the queries over training texts."""

import re

import pytest

from codexmill.llm import queries

SF = "/root/testdata/sf0.001"
ALL = queries.queries()


@pytest.mark.parametrize("name", ALL)
def test_no_nested_loops(spark, name):
    p = ALL[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", p)


def test_documents_are_read_as_often_for_many_items_as_for_few(spark, tmp_path):
    import random

    from codexmill.llm import leakage

    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    items = [(i, text(rnd.randrange(60, 400))) for i in range(1200)]
    docs = [(i, text(80) + items[i % len(items)][1] + text(80)) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    D = spark.read.parquet(str(tmp_path / "d"))
    scans = {}
    for n in (2, len(items)):
        got = leakage.leaked_passages(D, spark.createDataFrame(items[:n], "item_id long, text string"))
        scans[n] = len(re.findall("FileScan parquet", got._jdf.queryExecution().executedPlan().toString()))
        assert {tuple(r) for r in got.collect()} >= {(i, i) for i in range(min(n, 300))}
    assert len(set(scans.values())) == 1, scans
