"""Arguments keep their JSON types, and nothing of a tool call is lost."""

import json

from lodestar.llm import chat


def call(arguments, name="weather", **more):
    return json.dumps({"tool_calls": [{"id": "a", "name": name, "arguments": arguments}], **more}, ensure_ascii=False)


def test_arguments_and_content(spark):
    texts = [
        (call({"days": 3, "city": "é"}), True, {"city": "é", "days": 3}),
        (call({"days": "3", "city": "x"}), False, {"city": "x", "days": "3"}),
        (call({"days": 2.5, "city": 7}), False, {"city": 7, "days": 2.5}),
        (call({"days": 1, "city": None}), False, {"city": None, "days": 1}),
        (call({"days": 1, "city": {"b": 1, "a": [True, None, "x"]}}), False, {"city": {"a": [True, None, "x"], "b": 1}, "days": 1}),
        (call('{"days": -1, "city": "x"}'), True, {"city": "x", "days": -1}),
        (call("hello"), False, "hello"),
        (call(None), False, None),
        (call([1, 2]), False, "[1,2]"),
        (call({}), False, {}),
        ('{"tool_calls":[{"id":"a","name":"weather","arguments":{"days":"x","city":"u","days":4,"city":"v"}}]}', True, {"city": "v", "days": 4}),
        ('{"tool_calls":[{"id":"a","name":"weather","arguments":{"days":1,"city":{"a":1,"a":2}}}]}', False, '{"days":1,"city":{"a":1,"a":2}}'),
        (call({"query": "3"}, "search"), True, {"query": "3"}),
        (call({"query": 3}, "search"), False, {"query": 3}),
        (call({"x": 1}, "unknown"), None, {"x": 1}),
    ]
    rows = [(i, 0, "assistant", t) for i, (t, _, _) in enumerate(texts)]
    out = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == len(texts)
    for i, (text, valid, arguments) in enumerate(texts):
        want = {"role": "assistant", "id": "a", "name": json.loads(text)["tool_calls"][0]["name"], "arguments": arguments}
        assert out[i].valid is valid and json.loads(out[i].message) == want, (text, out[i])
        if isinstance(arguments, dict):
            assert list(json.loads(out[i].message)["arguments"]) == sorted(arguments)


def test_content_beside_calls(spark):
    rows = [(1, 4, "assistant", call({"query": "q"}, "search", content="Let me look.")), (1, 5, "tool", '{"tool_call_id":"a","content":"r"}')]
    out = sorted(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r.place, r.step))
    assert [json.loads(r.message) for r in out] == [{"role": "assistant", "content": "Let me look."}, {"role": "assistant", "id": "a", "name": "search", "arguments": {"query": "q"}}, {"role": "tool", "tool_call_id": "a", "content": "r"}]
    assert [(r.place, r.step, r.linked) for r in out] == [(4, -1, None), (4, 0, True), (5, 0, True)]
