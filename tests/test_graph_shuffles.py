"""Graph queries move edges no more often than they must."""

from __future__ import annotations

import pytest

from docloom import registry
from docloom.operators import graph as G


def _plan(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["graph_type_filter", "graph_endpoint"])
def test_type_filter_sorts_no_edges_and_moves_them_once_for_each_end(spark, sf, name):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark, registry.queries()[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(target_id") == 2 and plan.count("Exchange hashpartitioning(source_id") == 2


def test_type_filter_gives_each_edge_once(spark):
    n = spark.createDataFrame([("c", "chunk", None), ("a", "entity", "X"), ("b", "entity", "Y")], "id string, node_type string, entity_type string")
    e = spark.createDataFrame([("c", "a", "R")] * 3 + [("c", "a", "S"), ("c", "b", "R"), ("b", "a", "R"), ("c", "gone", "R")], "source_id string, target_id string, relation_type string")
    assert sorted(map(tuple, G.of_types(n, e, ["X"], most=None)[1].collect())) == [("c", "a", "R"), ("c", "a", "S")]
    assert G.view(n, e, ["X"]).first().edges == 2


def test_names_are_joined_without_sorting_edges(spark, sf):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark, registry.queries()["relations_named"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "SortMergeJoin" not in plan and "keys=[l_orderkey" in plan


@pytest.mark.parametrize("name", ["toc_end", "toc_categorise", "toc_candidate_counts", "toc_records"])
def test_texts_of_lines_stay_where_they_are_read(spark, sf, name):
    """What lines look like is told below the joins, once for each line."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [k for k, line in enumerate(plan) if "Join Inner" in line and "page#" in line]
    told = [k for k, line in enumerate(plan) if "annex|appendix" in line]
    assert joins and told and min(told) > min(joins)
