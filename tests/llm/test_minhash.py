import random
from itertools import combinations

from lodestar.llm import minhash


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, (_, a)), (y, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)], least[find(x)] == i) for x, (i, s) in enumerate(sets))


def test_same_as_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 9, 30, 80, 300]))
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(1 + len(t) // 25)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n"]).join(t).upper() if r.random() < 0.2 else " ".join(t))
    texts += [None, "", " \x0b\t", "É é", "é é", "a b", "A\x0cB", "a\x85b"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int"))
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_chain_and_empty_table(spark):
    words = [f"a{i}" for i in range(200)]
    chain = [" ".join(words[i : i + 100]) for i in range(0, 100, 5)]
    rows = list(enumerate(chain))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(frame).collect())) == brute(rows)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert {tuple(x) for x in null.select("doc_id").join(minhash.near_duplicates(null), "doc_id").collect()} == {(3, 1, 3, True)}
