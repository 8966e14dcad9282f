"""Stages of the pipeline on documents whose ids are repeated or null."""

from collections import Counter

from lodestar.llm import corpus_stages, minhash, mixing


def test_mixed_takes_what_the_mix_says(spark):
    texts = [(i, " ".join(["w"] * (3 + i % 7)), "abc"[i % 3]) for i in range(40)]
    texts += [(None, f"null id {i % 4}", "a") for i in range(12)] + [(7, f"other text {i}", "b") for i in range(9)] + [(5, "same row", "c")] * 6 + [(50, None, None)]
    docs = spark.createDataFrame([(*t, len(t[1] or "")) for t in texts], "doc_id long, text string, source string, n_chars int")
    copies = mixing.mix(docs).collect()
    out = corpus_stages.mixed(spark, docs, "")
    assert out.columns == docs.columns
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == sum(r.copies for r in copies) > 0
    per_id = Counter()
    for r in copies:
        per_id[r.doc_id, r.source, r.size] += r.copies
    assert Counter((i, s, len((t or "").split())) for i, t, s, _ in rows) == +per_id
    have = Counter((*t, len(t[1] or "")) for t in texts)
    assert all(n <= mixing.MOST_COPIES * have[r] for r, n in Counter(rows).items())


def words(start, n=100):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_null_and_repeated_ids_are_deduplicated(spark):
    # Two shifts by 5 of 100 words: neighbours are similar at 0.85 with three-word shingles, the ends of a chain are not.
    rows = [(1, words(0)), (None, words(5)), (2, words(10)), (None, words(1000)), (None, words(1000)), (None, words(1005)), (None, words(0)), (4, words(2000)), (4, words(3000)), (3, words(3000)), (3, words(4000)), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out if r.n_shingles) == Counter({(1, 1, True): 1, (2, 1, False): 1, (None, 1, False): 2, (None, None, True): 1, (None, None, False): 2, (4, 4, True): 1, (4, 3, False): 1, (3, 3, True): 2})
    assert all(r.kept for r in out if not r.n_shingles)


def test_one_document_of_each_group_stays(spark):
    rows = [(1, words(0)), (None, words(0)), (None, words(2)), (4, words(2000)), (4, words(3000)), (3, words(3000)), (None, words(5000)), (None, words(5000)), (6, words(6000)), (6, words(6000)), (7, None)]
    out = corpus_stages.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    stays = Counter((r.doc_id, r.text) for r in out)
    assert stays == Counter([(1, words(0)), (4, words(2000)), (3, words(3000)), (None, words(5000)), (6, words(6000)), (7, None)])
