from __future__ import annotations

import pytest
from oracle import compare

from millrace.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    compare(spark, *QUERIES[name])


def test_filter_and_columns_reach_the_scan(spark):
    from millrace.plans.catalogue import map_emit

    plan = map_emit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "partial_sum" in plan
