import hashlib
import re

from lodestar.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def test_digest_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tricky = ["", None, "token = 'abcdef' é PASSWORD:xyz", "é password: \"" + "a" * 30 + "\" " + "0" * 24, "AKIA" + "A" * 16 + "b", "secret=token=abcdef", "api_key=====", "api_key=abc=d", "x" * 200_000 + " apikey:1234567", "AKIA" + "B" * 15]
    docs = docs.union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = secrets.digest(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)], (r.doc_id, want)
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not want or set(joined.split(",")) <= set(r.spans.split(","))
