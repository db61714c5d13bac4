"""Tool calls: arguments that JSON allows and UTF-8 does not, and rows out against rows in."""

import collections
import json

import pytest

from pacemark.llm import tool_calls

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>, row long, record string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string, row long, result_turn long"
SCHEMA = [{"param": "x", "type": "integer", "required": True}]


@pytest.mark.parametrize("text,errors,record", [
    ('{"x": 1.0}', [], '{"x":1}'), ('{"x": 1}', [], '{"x":1}'), ('{"x": 1e2}', [], '{"x":100}'), ('{"x": -0.0}', [], '{"x":0}'),
    ('{"x": 1.5}', ["type x"], '{"x":1.5}'), ('{"x": NaN}', ["not json"], None), ('{"x": -Infinity}', ["not json"], None),
    ('{"x": 1e999}', ["number too large"], None), ('{"x": 123456789012345678901}', [], '{"x":123456789012345678901}'),
    ('{"x": 1, "\\ud800": 2}', ["unknown \\ud800"], '{"x":1,"\\ud800":2}'),
    ('{"x": 1, "q": "\\ud83d\\ude00"}', ["unknown q"], '{"q":"\U0001F600","x":1}'), (None, ["not json"], None), ("", ["not json"], None),
    ("[" * 100_000, ["not json"], None)])
def test_arguments_and_their_canonical_form(text, errors, record):
    value, wrong = tool_calls.check_arguments(text, SCHEMA)
    assert wrong == errors
    if record is not None:
        made = tool_calls.canonical(value)
        assert made == record and made.encode() and json.loads(made) == json.loads(text)


def test_every_row_comes_out_once(spark):
    calls = [(1, "a", 1, "f", '{"x": "\\ud800"}', None), (1, "a", 2, "f", '{"x": 1}', None), (1, "a", 2, "f", '{"x": 1}', None),
             (1, "a", 2, "g", None, ["zz"]), (1, "b", 3, "f", '{"x": NaN}', ["a"]), (1, None, 4, "f", '{"x": 4}', None), (None, "c", 5, None, None, None)]
    results = [(1, "a", 9, "late"), (1, "a", 8, "early"), (1, "a", 8, "early"), (1, None, 1, "no call é"), (None, "a", 1, None), (1, "q", 2, "alone")]
    out = tool_calls.link(spark.createDataFrame([(*c, 1, "r", "s") for c in calls], CALLS).repartition(3),
                          spark.createDataFrame([(*r, 1, 2) for r in results], RESULTS).repartition(2),
                          spark.createDataFrame([("f", "x", "integer", True)], "tool string, param string, type string, required boolean")).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.status].append(r)
    # the first result of "a" comes out with its call
    assert len(out) == len(calls) + len(results) - 1
    [a] = by["invalid"][:1] if by["invalid"][0].call_id == "a" else by["invalid"][1:]
    assert (a.turn, a.errors, a.result_turn) == (1, "type x", 8) and json.loads(a.record)["result"] == "early"
    assert sorted((r.turn, r.tool, json.loads(r.record)["arguments"] is None) for r in by["duplicate"]) == [
        (2, "f", False), (2, "f", False), (2, "g", True)]
    assert sorted((r.turn, r.tool) for r in by["no_id"] if r.tool) == [(4, "f")] and len(by["no_id"]) == 2
    assert sorted((r.result_turn, json.loads(r.record)["result"]) for r in by["repeated"]) == [(8, "early"), (9, "late")]
    assert sorted(str(json.loads(r.record)["result"]) for r in by["orphan"]) == ["None", "alone", "no call é"]
    bad = next(r for r in out if r.call_id == "b")
    assert bad.errors == "not json" and json.loads(bad.record)["arguments"] == '{"x": NaN}'
