"""Tool calls: linking, order, checks and canonical JSON."""

from __future__ import annotations

import json

from fileledger.llm import tool_calls

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after string"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
SCHEMAS = "name string, parameter string, type string, required boolean"


def link(spark, calls, results, schemas=()):
    return tool_calls.link_tool_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(list(schemas), SCHEMAS)
    )


RULES = [
    ("f", "q", "string", True), ("f", "n", "integer", False), ("f", "x", "number", False), ("f", "o", "object", False),
    ("f", "a", "array", False), ("f", "b", "boolean", False), ("f", "q", "string", True), (None, "z", "string", True),
]


def test_status_and_errors(spark):
    good = '{"q": "é\\n\\"", "o": {"z": 1, "a": [2.50, null]}, "n": 3}'
    calls = [
        (1, "a", 0, "f", good, None),
        (1, "a", 5, "f", "{}", None),  # told again later
        (1, "b", 2, "f", '{"n": "3", "x": 1, "b": true}', "a"),
        (1, "c", 4, "f", '{"q": null, "y": 1}', "b"),
        (1, "d", 6, "f", "[1]", None),
        (1, "e", 8, "f", '{"q": "x"', None),
        (1, "f", 10, "g", "{}", None),
        (1, "g", 12, "f", '{"q": "x"}', "nobody"),
        (1, "h", 14, "f", '{"q": "x"}', None),
        (1, "i", 16, "f", '{"q": "x"}', None),
        (2, "a", 0, "f", '{"q": "x"}', "b"),
        (2, "b", 1, "f", '{"q": "x"}', "c"),
        (2, "c", 2, "f", '{"q": "x"}', "a"),
        (2, "d", 3, "f", '{"q": "x"}', "a"),
        (None, "a", 0, "f", '{"q": "x"}', None),
        (3, None, 0, "f", None, None),
        (4, "a", 0, "f", None, None),
    ]
    results = [(1, "a", 1, "first"), (1, "a", 1, "last"), (1, "a", 9, "late"), (1, "i", 16, "early"), (9, "z", 1, "nobody's"), (None, "a", 1, "x"), (2, "a", 1, None)]
    rows = {(r.conv_id, r.call_id): r for r in link(spark, calls, results, RULES).collect()}
    assert len(rows) == 16
    status = {k: (r.status, r.errors) for k, r in rows.items()}
    assert status[1, "a"] == ("ok", [])
    assert status[1, "b"] == ("invalid", ["missing: q", "type: n"])
    assert status[1, "c"] == ("invalid", ["missing: q", "unknown: y"])
    assert status[1, "d"] == status[1, "e"] == status[4, "a"] == ("invalid", ["no JSON object"])
    assert status[1, "f"] == ("invalid", ["no such tool"])
    assert status[1, "g"][0] == "dangling" and status[1, "h"][0] == "unanswered" and status[1, "i"][0] == "early"
    assert all(status[2, c][0] == "circular" and rows[2, c].level is None for c in "abcd")
    assert status[None, "a"][0] == status[3, None][0] == "unnamed" and rows[3, None].place is None
    assert rows[1, "a"].json == (
        '{"after":null,"arguments":{"n":3,"o":{"a":[2.5,null],"z":1},"q":"é\\n\\""},"id":"a","name":"f","result":"first"}'
    )
    assert json.loads(rows[1, "e"].json)["arguments"] is None
    levels = [(rows[1, c].level, rows[1, c].place) for c in "abc"]
    assert [x for x, _ in levels] == [0, 1, 2]
    assert sorted(r.place for k, r in rows.items() if k[0] == 1) == list(range(1, 10))


def test_long_chain_is_ordered(spark):
    calls = [(1, f"c{i}", (i * 7) % 60, "f", "{}", f"c{i - 1}" if i else None) for i in range(60)]
    rows = {r.call_id: r for r in link(spark, calls, []).collect()}
    assert all(rows[f"c{i}"].level == i and rows[f"c{i}"].place == i + 1 for i in range(60))


def test_empty_tables(spark):
    assert link(spark, [], []).count() == 0


def test_no_python_runs(spark):
    found = tool_calls.op6_tool_calls(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
