"""A model's reply is taken apart once."""

from __future__ import annotations

from docloom import registry
from docloom.operators import extraction as X


def test_fence_is_looked_for_once(spark, sf):
    got = registry.queries()["llm_entity_reply"](spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```json\\s*") == 1


def test_odd_replies(spark):
    one = '{"name": "A b", "type": "x"}'
    said = [None, "", "  ", "[]", f"[{one}]", f'```json\n{{"entities": [{one}, {one}]}}\n```', f"```\n[{one}]\n```", "```json\nno\n```", '{"entities": null}', '{"a": 1}', "7"]
    rows = X.from_replies(spark.createDataFrame(list(enumerate(said)), "k long, reply string"))
    assert sorted((r.k, r.ord, r.name) for r in rows.collect()) == [(4, 0, "A b"), (5, 0, "A b"), (5, 1, "A b"), (6, 0, "A b")]
