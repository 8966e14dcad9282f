import random

import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def machine():
    return bpe.Bpe(open(PATH, encoding="utf-8").read())


def test_same_as_the_library(machine):
    library = Tokenizer.from_file(PATH)
    r = random.Random(1)
    alphabet = ["a", "b", "the", "ing", "é", "ß", " ", " ", "\n", "'s", "9", "!", "<", "/w>", "\x1c", "́", "İ", "Σ", "日", "\U0001f600", "<|endoftext|>", "xx", "x", "\x00", "\xad", "\x85"]
    texts = ["", "Hello world's  best", "</w>", "a</w>b"] + ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3000)]
    texts += ["".join(r.choices("aehinorst", k=r.randrange(1, 25))) for _ in range(5000)] + ["x" * n for n in range(40)]
    texts += ["ab " * 50_000]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for t, a, b in zip(texts, machine.encode(texts), wanted):
        assert a.tolist() == b.ids, t[:100]
        assert machine.decode(a) == library.decode(b.ids, skip_special_tokens=False)
    assert 0 < machine.failed < len(machine.known)


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "", 7), (None, "the cat", 7)], "doc_id long, text string, ids int")
    out = {(r.doc_id, r.n_tokens) for r in bpe.digest(rows).collect()}
    assert out == {(1, 0), (2, 0), (None, 2)}
    full = bpe.tokenise(rows)
    assert full.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.decoded for r in full.collect()} == {"", "the</w> cat</w>"}
    assert bpe.digest(rows.limit(0)).count() == 0
