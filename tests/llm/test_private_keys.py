"""Redaction leaves nothing of a private key."""

import base64
import random

import pytest

from lodestar.llm import secrets

NAMES = ["PRIVATE KEY", "RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "ANY OTHER NAME 2 PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]


def key(name, joint, end=True, headers=""):
    body = base64.b64encode(random.Random(name + joint).randbytes(400)).decode()
    lines = [f"-----BEGIN {name}-----", *headers.splitlines(), *(body[i : i + 64] for i in range(0, len(body), 64))]
    return joint.join(lines + [f"-----END {name}-----"] * end), body


@pytest.mark.parametrize("end", [True, False])
def test_nothing_is_left(spark, end):
    texts, wanted, bodies = [], [], []
    for name in NAMES:
        for joint in ["\n", "\r\n", "\\n", "\n    ", '\\n" +\n  "', " ", "\n> "]:
            for headers in ["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n"] if joint == "\n" else [""]:
                k, body = key(name, joint, end, headers)
                texts += [f"é before\n{k}\nIt goes on, ü.", k, f"{k}\n{k}"]
                wanted += ["é before\n[SECRET]\nIt goes on, ü.", "[SECRET]", "[SECRET]\n[SECRET]"]
                bodies += [body] * 3
    out = secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        body = bodies[r.doc_id]
        assert not any(body[i : i + 12] in r.text for i in range(0, len(body) - 12)), (texts[r.doc_id], r.text)
        # Where nothing ends the last key, white space before the next key may go with it.
        assert r.text.replace("\n", "") == wanted[r.doc_id].replace("\n", ""), (texts[r.doc_id], r.text)


def test_offsets_and_prose():
    k, _ = key("EC PRIVATE KEY", "\n")
    texts = ["é" + k + "é", "A key opens with -----BEGIN PRIVATE KEY----- and has a body.", "-----BEGIN PUBLIC KEY-----\nAAAA\n-----END PUBLIC KEY-----"]
    found = [[s for s in x if secrets.RULES[s[2]].kind == "private_key"] for x in secrets.spans_in(texts, secrets.RULES, secrets.compiled())]
    assert [[(a, b) for a, b, _ in x] for x in found] == [[(1, 1 + len(k))], [(17, 44)], []]
