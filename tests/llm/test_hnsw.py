import numpy as np

from lodestar.llm import hnsw


def brute(ids, vectors, every=50, k=5):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i, x in zip(ids, u):
        if i % every == 0:
            out[i] = sorted(((-round(float(s), 9), j) for j, s in zip(ids, u @ x) if j != i))[:k]
    return out


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = r.normal(size=(3000, 24)).astype(np.float32)
    vectors[100:400] = vectors[100]
    frame = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank int")
    got = {}
    for x in hnsw.search(frame).collect():
        got.setdefault(x.query_id, {})[x.rank] = (-round(x.score, 9), x.vec_id)
    want = brute(list(range(3000)), vectors.astype(np.float64))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert np.mean([len({v for _, v in want[q]} & {v for _, v in got[q].values()}) / 5 for q in want]) >= 0.95
    assert [v for _, v in sorted(got[100].values())] == [101, 102, 103, 104, 105]


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 3.0]), (50, [0.0, 0.0]), (7, [1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in hnsw.search(frame).collect()) == [(0, 1, 1, 1.0), (0, 2, 6, 0.0)]
    assert hnsw.search(frame.limit(0)).count() == 0
