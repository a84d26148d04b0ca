import json

import pytest

from shelfspark.llm import chat

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "unit": {"enum": ["m", "s"]}, "xs": {"type": "array", "items": {"type": "string"}}}, "required": ["a"], "additionalProperties": False}}
CALLS = "conv_id long, position long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, position long, call_id string, content string"


@pytest.mark.parametrize(
    ("arguments", "want"),
    [
        ('{"b": 1.5, "a": 1}', ('{"a":1,"b":1.5}', None)),
        (None, ("{}", "arguments: a is missing")),
        ('{"a": true}', ('{"a":true}', "a: not of type integer")),
        ('{"a": 1, "c": 2}', ('{"a":1,"c":2}', "arguments: c is not known")),
        ('{"a": 1, "unit": "é"}', ('{"a":1,"unit":"é"}', "unit: not one of the values allowed")),
        ('{"a": 1, "xs": ["p", 3]}', ('{"a":1,"xs":["p",3]}', "xs[1]: not of type string")),
        ("[1]", ("[1]", "arguments: not of type object")),
        ("{", (None, "arguments: not JSON")),
    ],
)
def test_arguments(arguments, want):
    assert chat.checked("add", arguments, SCHEMAS) == want


def test_unknown_tool():
    assert chat.checked("mul", "{}", SCHEMAS) == ("{}", "unknown tool")


def run(spark, calls, results):
    return chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)


def test_links_and_states(spark):
    calls = [(1, 1, "x", "add", '{"a":1}', []), (1, 1, "x", "add", '{"a":1}', []), (1, 5, "x", "add", '{"a":2}', []), (1, 3, "y", "add", '{"a":"q"}', ["x", "gone"]), (2, 1, "x", "add", None, None), (None, 1, "x", "add", "{}", []), (2, 4, None, "add", "{}", [])]
    results = [(1, 2, "x", "first"), (1, 9, "x", "second"), (2, 0, "x", "too early"), (3, 1, "lost", None)]
    rows = {(r.conv_id, r.call_id, r.position): r for r in run(spark, calls, results).collect()}
    assert {k: r.status for k, r in rows.items()} == {(1, "x", 1): "linked", (1, "x", 5): "duplicate", (1, "y", 3): "pending", (2, "x", 1): "pending", (2, "x", 0): "early", (3, "lost", 1): "orphan"}
    assert rows[1, "x", 1].message == '{"arguments":{"a":1},"depends_on":[],"id":"x","name":"add","result":"first","status":"linked"}'
    assert rows[1, "y", 3].error == "a: not of type integer"
    assert json.loads(rows[3, "lost", 1].message) == {"id": "lost", "result": None, "status": "orphan"}


def test_topological_order_with_forward_references_and_circles(spark):
    deps = {"a": ["d"], "b": ["a"], "c": [], "d": ["e"], "e": [], "f": ["a"], "g": ["h"], "h": ["g"], "i": ["i"], "j": ["g"]}
    calls = [(1, n, name, "add", '{"a":1}', on) for n, (name, on) in enumerate(deps.items())]
    rows = run(spark, calls, []).collect()
    order = [r.call_id for r in sorted(rows, key=lambda r: (r.order_key, r.order_step, r.position))]
    cyclic = {r.call_id for r in rows if r.status == "cyclic"}
    assert cyclic == {"g", "h", "i"}
    for name, on in deps.items():
        for x in on:
            if name not in cyclic:
                assert order.index(x) < order.index(name)


def test_calls_behind_a_circle_are_not_cyclic_and_come_after_it(spark):
    deps = {"k": ["j"], "j": ["g"], "free": [], "g": ["h"], "h": ["g", "free"], "m": ["p"], "n": ["h", "m"], "p": ["n"]}
    calls = [(c, n, name, "add", '{"a":1}', on) for c in (1, 2) for n, (name, on) in enumerate(deps.items())]
    rows = [r for r in run(spark, calls, []).collect() if r.conv_id == 2]
    order = [r.call_id for r in sorted(rows, key=lambda r: (r.order_key, r.order_step, r.position))]
    assert {r.call_id for r in rows if r.status == "cyclic"} == {"g", "h", "m", "n", "p"}
    assert order.index("free") < order.index("h") and max(order.index("g"), order.index("h")) < order.index("j") < order.index("k")


def test_a_forward_chain_takes_few_rounds(spark, monkeypatch):
    calls = [(1, n, f"c{n:04}", "add", '{"a":1}', [f"c{n + 1:04}"]) for n in range(1000)]
    written, write = [], chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda df: written.append(1) or write(df))
    rows = sorted(run(spark, calls, []).collect(), key=lambda r: (r.order_key, r.order_step, r.position))
    assert [r.call_id for r in rows] == [f"c{n:04}" for n in reversed(range(1000))]
    assert len(written) <= 32  # two searches of at most 12 rounds each, and the tables beside them


def test_a_chain_in_order_needs_no_rounds(spark):
    calls = [(1, n, f"c{n}", "add", '{"a":1}', [f"c{n - 1}"]) for n in range(500)]
    rows = run(spark, calls, [(1, n + 1, f"c{n}", "r") for n in range(500)]).collect()
    assert [(r.order_key, r.order_step, r.status) for r in sorted(rows, key=lambda r: r.position)] == [(n, 0, "linked") for n in range(500)]


def test_messages_and_empty_tables(spark):
    text = json.dumps({"tool_calls": [{"id": "k", "name": "add", "arguments": '{"a": 3}', "depends_on": []}]})
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "tool", '{"tool_call_id":"k","content":"3"}'), (1, 3, "assistant", None)], "conv_id long, turn int, role string, text string")
    rows = chat.link_calls(*chat.parse_messages(messages), SCHEMAS).collect()
    assert [(r.call_id, r.status, json.loads(r.message)["result"]) for r in rows] == [("k", "linked", "3")]
    assert chat.link_calls(*chat.parse_messages(messages.limit(0)), SCHEMAS).collect() == []


def test_arguments_that_no_parser_takes_are_errors_of_one_call():
    schemas = {"f": {"type": "object"}}
    for bad in ("[" * 100_000 + "]" * 100_000, '{"x": "\\ud800"}', '{"x": NaN}', '{"x": 1e999}', '{"x": -Infinity}', "{"):
        assert chat.checked("f", bad, schemas) == (None, "arguments: not JSON")
    assert chat.checked("f", '{"b": 1, "a": "\\u00e9"}', schemas) == ('{"a":"é","b":1}', None)
    assert chat.checked("g", "{}", schemas) == ("{}", "unknown tool")


def test_deep_arguments_are_an_error_of_their_call(spark):
    rows = []
    for n, levels in enumerate((chat.DEPTH, chat.DEPTH + 1, 9_998, 200_000)):
        rows.append(("c", n, f"call-{n}", "any", "[" * levels + "]" * levels, []))
        rows.append(("d", n, f"call-{n}", "any", '{"a":' * levels + "1" + "}" * levels, []))
    calls = spark.createDataFrame(rows, "conv_id string, position long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("c", 9, "call-0", "x")], "conv_id string, position long, call_id string, content string")
    got = {(r.conv_id, r.position): r for r in chat.link_calls(calls, results, {"any": {}}).collect()}
    assert {k: r.error for k, r in got.items()} == {(c, n): "arguments: not JSON" if n else None for c in "cd" for n in range(4)}
    assert all(r.message for r in got.values())
    assert not chat.deeper([[1], {"a": 2}], 2)
    assert chat.deeper([[1], {"a": [2]}], 2)
