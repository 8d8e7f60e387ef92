"""Shapes of the physical plans: no crossed or nested-loop joins, pruned scans."""

import re

import pytest

from codexmill.plans import analysis, corpus, records, sources

SF = "/root/testdata/sf0.001"
ALL = corpus.QUERIES | records.QUERIES | sources.QUERIES | analysis.QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ALL)
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|NestedLoop", plan(ALL[name](spark, SF)))


def test_scans_read_only_what_is_asked(spark):
    p = plan(corpus.QUERIES["work_lookup"](spark, SF))
    assert "raw_text" not in p and "IsNotNull(work_id)" in p
    p = plan(corpus.QUERIES["hash_bucket"](spark, SF))
    assert re.search(r"ReadSchema: struct<id:bigint,source_path:string>", p)
    assert "WindowGroupLimit" in plan(corpus.QUERIES["compare_groups"](spark, SF))
