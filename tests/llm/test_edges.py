"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe, chat, corpus_stages, hnsw, language, license, minhash, mixing, quality_model, quality_rules, queries, secrets

LONG = "alpha beta gamma delta " * 40_000 + "the end"
TEXTS = [(1, "the cat and the dog went to the park and it was fun", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"), (5, LONG, "en", "a"), (6, "der hund und die katze", "de", "b"), (6, "der hund und die katze", "de", "b"), (None, "no id here", "en", None), (7, "½ ² Ⅷ 12", "en", "c"), (8, "token = 'abcdef123' é", "en", "c")]
#: Names that operators use themselves.
CLASH = "node string, score double, size int, kept boolean, ids string, matches int, _score double, h string, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, len(t or ""), "x", 0.5, 1, True, "y", 2, 0.1, "z", "d") for i, t, g, s in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {CLASH}").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "quality": lambda d: quality_model.classify(d, labels),
        "minhash": minhash.near_duplicates,
        "license": license.scan,
        "rules": quality_rules.quality_rules,
        "secrets": secrets.digest,
        "language": lambda d: language.identify(d, language.train(d)),
        "mixing": mixing.mix,
        "bpe": bpe.digest,
    }


NAMES = ["quality", "minhash", "license", "rules", "secrets", "language", "mixing", "bpe"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_its_answer(docs, labels, name):
    run = operators(labels)[name]
    out = run(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in TEXTS)
    plain = run(docs.select("doc_id", "text", "lang", "source")).collect()
    assert Counter(map(str, out)) == Counter(map(str, plain))  # clashing columns change nothing, reruns agree
    assert run(docs.limit(0)).count() == 0
    if name in ("license", "rules", "secrets", "bpe", "language", "quality", "minhash"):
        twice = [r for r in out if r.doc_id == 6]
        assert str(twice[0]) == str(twice[1])  # repeated rows


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_defined_results(docs, labels):
    rules = by_id(quality_rules.quality_rules(docs))
    assert rules[2].n_words == rules[3].n_words == rules[4].n_words == 0 and rules[2].base_failed and not rules[2].kept
    assert rules[5].n_words == 160_002 and rules[5].n_repeat_words == 160_000 and rules[5].base_failed
    spoken = by_id(language.identify(docs, language.train(docs)))
    assert [spoken[i].lang_pred for i in (2, 3, 4, 7)] == ["und"] * 4 and spoken[None].held_out
    near = by_id(minhash.near_duplicates(docs))
    assert near[2].n_shingles == 0 and near[2].kept and near[5].n_shingles == 6
    hidden = by_id(secrets.digest(docs))
    assert hidden[8].n_assign == 1 and hidden[2].n_assign == 0 and hidden[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    taken = by_id(mixing.mix(docs))
    assert taken[2].size == 0 and taken[2].taken == 0 and taken[None].source_size == 3


def test_rules_and_mixing_same_as_sql(docs):
    db = duckdb.connect()
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])  # the SQL tells texts apart by id
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    for column in ("text", "source"):
        documents[column] = documents[column].astype(object).where(documents[column].notna(), None)
    db.register("documents", documents)
    for name, frame in (("op4_quality_rules", quality_rules.quality_rules(docs)), ("op8_mixing", mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken"))):
        want = db.execute(f"select {', '.join(frame.columns)} from ({queries.ORACLES[name]})").fetchall()
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(map(tuple, frame.collect()), key=key) == sorted(want, key=key)


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97), "abc"[min(i % 5, 2)]) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.03 * mine[0].target
        assert all(r.taken <= 2 * r.size for r in mine) and mine[0].target <= 2 * mine[0].source_size
    assert abs(sum({r.source: r.target for r in out}.values()) - 1.5 * sum(r.size for r in out)) < 1e-6


def test_language_same_as_plain_counts(spark):
    """Predictions against a direct reading of the rule: words, else the longest known n-grams, mean evidence."""
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog sat", "en"), ("a dog barked at the moon", "en"), ("der hund und die katze", "de"), ("ein hund bellt den mond an", "de")] * 12)], "doc_id long, text string, lang string")
    model = language.train(docs)
    tables = [{g: m[row] for g, row in rows.items()} for rows, m in zip(model.rows, model.logs, strict=True)]
    for text in ("the hund", "moonlight", "katzen bellen", "zzz", "the the the katze", "dogs & cats 12"):
        total, n = np.zeros(2), 0
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            n += 1
            if w in tables[0]:
                total += tables[0][w]
                continue
            for size in range(4, 0, -1):
                padded = f"<{w}>" if size > 1 else w
                found = [tables[size][padded[i : i + size]] for i in range(len(padded) - size + 1) if padded[i : i + size] in tables[size]]
                if found:
                    total += np.mean(found, 0)
                    break
        z = np.exp((total - total.max()) / n * max(math.sqrt(n), 1))
        name, score = model.predict(text)
        assert name == model.names[int(np.argmax(total))] and abs(score - z.max() / z.sum()) < 1e-6


def test_repeated_ids_do_not_swell_the_sample(spark):
    docs = spark.createDataFrame([(2, "the cat", "en")] * 500 + [(2, "the dog", "en"), (3, "le chat", "fr")], "doc_id long, text string, lang string")
    model = language.train(docs, 20)
    assert model.predict("the dog")[0] == "en" and set(model.names) <= {"en", "fr"}


def test_held_out_accuracy(spark):
    """Quality and language on documents that were not learned from."""
    at = "/root/testdata/sf0.01/"
    documents, marks = spark.read.parquet(at + "documents.parquet"), spark.read.parquet(at + "labels.parquet")
    truth = {r.doc_id: r.quality for r in marks.collect() if r.quality is not None}
    scored = [(truth[r.doc_id], r.predicted) for r in quality_model.classify(documents, marks).collect() if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in scored) >= 0.9 * len(scored) > 20
    langs = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect() if r.lang is not None}
    said = [(langs[r.doc_id], r.lang_pred) for r in language.identify(documents, language.train(documents)).collect() if r.held_out and r.doc_id in langs]
    assert sum(a == b for a, b in said) >= 0.97 * len(said) > 50


def test_very_long_word():
    import time

    machine = bpe.Bpe(open(bpe.default_path(), encoding="utf-8").read())
    r = np.random.default_rng(1)
    word = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    began = time.time()
    ids = machine.encode([word])[0].tolist()
    assert time.time() - began < 60
    assert ids == Tokenizer.from_file(bpe.default_path()).encode(word, add_special_tokens=False).ids


def test_exact_links_with_a_large_list(spark):
    """Many similar sets that are not linked: the same lists, all pairs below the threshold, and one true pair among them."""
    r = np.random.default_rng(2)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(600):
        words = list(base)
        for j in r.choice(100, 5, replace=False):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    rows += [(1000, rows[7][1] + " tail"), (None, rows[7][1] + " tail two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min((v for v in (least.get(find(x)), i) if v is not None), default=None)
    want = Counter((i, least[find(x)]) for x, (i, _) in enumerate(rows))
    for margin in (minhash.MARGIN, None):
        assert Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame, margin=margin).collect()) == want


def test_license_offsets_and_spread(spark):
    text = "İİİ before. Licensed under the Apache License, Version 2.0. After"
    found = license.Scanner(license.templates())(text)
    assert [(m["license"], text[m["start"] : m["end"]]) for m in found] == [("Apache-2.0", "Licensed under the Apache License, Version 2.0")]


def test_neighbours_edges(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 2.0]), (100, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])] + [(50, [1.0, 0.0])] * 20
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.search(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 6)))
    assert sorted(got[100]) == [(1, 4, 0.0)]
    assert [v for _, v, _ in sorted(got[50])][:3] == [1, 1, 3] and 50 not in {v for _, v, _ in got[50]}


def test_chat_edges(spark):
    frame = spark.createDataFrame([(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, 1, "tool", '{"tool_call_id":"a"}', 1), (2, None, "assistant", "{ not json", 1), (3, 0, "assistant", "x" * 1_000_000, 1)], "conv_id long, turn long, role string, text string, message int")
    out = chat.format_chat(frame).collect()
    assert len(out) == 5 and Counter(r.conv_id for r in out)[1] == 2
    assert chat.format_chat(frame.limit(0)).count() == 0


@pytest.mark.parametrize("stage", ["good_quality", "without_near_copies", "without_secrets", "mixed"])
def test_stages_keep_rows_and_columns(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    run = getattr(corpus_stages, stage)
    out = run(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert set(r.doc_id for r in out.collect()) <= {i for i, *_ in TEXTS}
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
