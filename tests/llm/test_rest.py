"""Small tests of the license, chat, secret, language and quality operators."""

import re

from lodestar.llm import chat, language, license, quality_model, secrets


def test_licenses(spark):
    t = "Some prose here and more.\nLicensed under the Apache License, Version 2.0.\nThe end of it"
    rows = spark.createDataFrame([(1, t, 0), (2, None, 0), (3, "", 0), (4, "released under the law of the land", 0), (5, "RELEASED under the MIT license", 0)], "doc_id long, text string, matches int")
    out = {r.doc_id: [(m.license, m.start, m.end) for m in r.matches] for r in license.scan(rows).collect()}
    assert out[1] == [("Apache-2.0", 26, 72)] and out[5] == [("MIT", 0, 30)]
    assert out[2] == out[3] == out[4] == []


def test_chat_links(spark):
    call = '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"x"}},{"id":"b","name":"weather","arguments":{"days":"soon"}}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"a","content":"r"}'), (1, 2, "assistant", call), (2, 0, "tool", '{"tool_call_id":"a","content":null}'), (2, 1, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat.format_chat(frame).collect(), key=lambda r: (r.conv_id, r.place, r.step))
    assert [(r.conv_id, r.turn, r.call_id, r.linked, r.valid) for r in out] == [(1, 0, None, None, None), (1, 2, "a", True, True), (1, 2, "b", False, False), (1, 1, "a", True, None), (2, 0, "a", False, None), (2, 1, None, None, None)]
    assert out[1].message == '{"role":"assistant","id":"a","name":"search","arguments":{"query":"x"}}'
    assert chat.format_chat(frame.limit(0)).count() == 0


BASE = {"assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def test_secrets_same_as_regexes():
    texts = ["", "é password: 'abc' x token==abcdef", "API_KEY = \"abc/def=\" AKIA" + "Q" * 16, "f" * 24 + " " + "a" * 23, "secret:12345", "AKIA" + "A" * 15, "ü" * 9 + "passwd='hunter22'" * 3]
    for t, found in zip(texts * 50, secrets.spans_in(texts * 50, secrets.RULES, secrets.compiled())):
        want = []
        for k, (kind, p) in enumerate(BASE.items()):
            for m in p.finditer(t):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]:
                    want.append((m.start(), m.end(), k))
        assert [s for s in found if s[2] < 3] == sorted(want, key=lambda s: (s[0], s[2]))


def test_language_and_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30 + [(None, "en"), ("123 !!", None), ("", "de"), ("the hund", None)])], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert len(out) == 64 and out[0].lang_pred == "en" and out[1].lang_pred == "de"
    assert (out[60].lang_pred, out[61].lang_pred, out[62].score) == ("und", "und", 0.0)
    assert language.identify(docs, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scored = quality_model.classify(docs, labels).collect()
    assert len(scored) == 64 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == r.doc_id % 2 for r in scored if r.doc_id < 60)
    assert {r.score for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}
