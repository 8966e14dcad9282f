"""Files, saved indexes, updates as a stream, graphs and what training and presets promise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import adaptive, codecs, evaluate, exact, graph, ivf, presets, routing, space, training
from lodestar.plans.tables import Tables
from lodestar.sources import binary, index
from lodestar.streaming import updates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_unusable_vectors_and_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0])], "vec_id long, embedding array<float>")
    good = space.usable(rows).select("vec_id", F.col("embedding").alias("x"))
    assert {r.vec_id for r in good.collect()} == {1, 6, 8}
    got = exact.exact_knn(good, good.withColumnRenamed("vec_id", "qid"), 5, "ip").collect()
    assert sorted((r.qid, r.rank, r.vec_id) for r in got) == [(1, 1, 6), (1, 2, 8), (6, 1, 1), (6, 2, 8), (8, 1, 1), (8, 2, 6)]
    assert space.usable(rows.limit(0)).count() == 0
    zero = space.Space(1, np.zeros(2), 0.0)
    assert zero.normalise(np.zeros((1, 2))).tolist() == [[0, 0]] and zero.quantise(np.zeros((1, 2))).tolist() == [[0, 0]]


def test_exact_knn_same_as_brute_force(spark, t):
    rows = t.raw.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.x for r in rows], float)
    frame = exact.exact_knn(t.raw, t.raw.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), 10, "l2")
    assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    for r in frame.collect():
        d = ((x - x[ids == r.qid][0]) ** 2).sum(1)
        want = sorted((s, i) for s, i in zip(d, ids, strict=True) if i != r.qid)[r.rank - 1]
        assert want[1] == r.vec_id and abs(want[0] - r.score) < 1e-9


@pytest.mark.parametrize("kind", ["float32", "int8", "uint32"])
def test_files(spark, tmp_path, kind):
    m = np.random.default_rng(1).integers(0, 100, (50, 6))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, x array<int>")
    binary.write(rows, str(tmp_path / "all"), kind, parts=3)
    back = binary.read(spark, str(tmp_path / "all"), type=kind)
    assert {(r.vec_id, *r.x) for r in back.collect()} == {(i, *v) for i, v in enumerate(m.tolist())}
    one = tmp_path / "one"
    item = binary.TYPES[kind][0]
    one.write_bytes(np.array(m.shape, "<u4").tobytes() + b"\0" * 56 + m.astype(item).tobytes())
    part = binary.read(spark, str(one), type=kind, dataOffset="64", start="10", count="5").collect()
    assert sorted((r.vec_id, *r.x) for r in part) == [(i, *m[10 + i].tolist()) for i in range(5)]
    assert binary.read(spark, str(one), type=kind, dataOffset="64", limit="3").count() == 3
    one.write_bytes(np.array((51, 6), "<u4").tobytes() + m.astype(item).tobytes())
    with pytest.raises(Exception, match="do not hold"):
        binary.read(spark, str(one), type=kind).count()


def test_truth_and_graph_files(spark, tmp_path):
    found = spark.createDataFrame([(0, 1, 5), (0, 2, 7), (1, 1, 9)], "qid long, rank int, vec_id long")
    binary.write_ranked(found, str(tmp_path / "gt"), 3, 1)
    assert sorted(map(tuple, binary.read_truth(spark, str(tmp_path / "gt")).collect())) == [(0, 1, 5), (0, 2, 7), (1, 1, 9)]
    (tmp_path / "g").write_bytes(np.array([[1, 2], [0, 2**32 - 1], [0, 1]], "<u4").tobytes())
    assert sorted(map(tuple, binary.read_graph(spark, str(tmp_path / "g"), 3).collect())) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (2, 1, 0), (2, 2, 1)]


def test_saved_index(spark, t, tmp_path):
    book = training.fixed_book(t.rows, 2)
    index.save(index.Index(t.lists, t.tree, t.space, book, {"probes": 4}), str(tmp_path))
    back = index.load(spark, str(tmp_path))
    assert ivf.same_results(back.lists.select("cell", "vec_id"), t.lists.select("cell", "vec_id")).first()[:] == (0, 0)
    assert all((a == b).all() for a, b in zip(back.cells.levels + [back.codec.book, back.space.mean], t.tree.levels + [book.book, t.space.mean], strict=True))
    assert (back.cells.parents[1] == t.tree.parents[1]).all() and back.params == {"probes": 4}
    spark.createDataFrame([(2, "{}")], "version int, meta string").write.mode("overwrite").parquet(str(tmp_path / "meta"))
    with pytest.raises(ValueError, match="version 2"):
        index.load(spark, str(tmp_path))


def test_stream_equals_rebuild(spark, t, tmp_path):
    rows = t.raw.where("vec_id < 120")
    live = updates.LiveIndex(spark, str(tmp_path / "index"), t.space, t.cells)
    live.build(rows.where("vec_id < 60"))
    assert live.rows().count() == 60
    log = rows.where("vec_id >= 50").select(F.col("vec_id").alias("seq"), F.lit("I").alias("op"), "vec_id", "x")
    none = F.lit(None).cast("array<float>").alias("x")
    for n, part in enumerate([log.where("seq < 90"), log.where("seq >= 90"), rows.where("vec_id % 5 = 0").select((F.col("vec_id") + 1000).alias("seq"), F.lit("D").alias("op"), "vec_id", none).union(spark.createDataFrame([(2000, "I", 5, [0.5] * 64), (2001, "I", 500, None), (2002, "D", 9999, None)], updates.LOG))]):
        part.select("seq", "op", "vec_id", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "ops" / f"part={n}"))
    stream = spark.readStream.schema(updates.LOG + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops")).drop("part")
    for _ in range(2):
        stream.writeStream.foreachBatch(live.apply).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    live.apply(spark.read.schema(updates.LOG).parquet(str(tmp_path / "ops" / "part=0")), 77)
    got = {r.vec_id: r.x for r in live.rows().collect()}
    assert set(got) == {i for i in range(120) if i % 5} | {5} and got[5] == [0.5] * 64
    queries = rows.where("vec_id in (1, 2, 100)").withColumnRenamed("vec_id", "qid")
    found = live.search(queries, 20)
    truth = exact.exact_knn(live.rows(), queries, 10, "l2")
    assert ivf.same_results(found.select("qid", "rank", "vec_id"), truth.select("qid", "rank", "vec_id")).first()[:] == (0, 0)
    small = live.compact(str(tmp_path / "compact"))
    assert small.log().count() == 0 and ivf.same_results(small.rows(), live.rows()).first()[:] == (0, 0)


def test_training(t):
    _, inertia = training.k_means(t.rows, 10, 4)
    assert all(a >= b for a, b in zip(inertia, inertia[1:], strict=False))
    fixed, trained = training.fixed_book(t.rows, 2), training.train_product(t.rows, 2, steps=3)
    assert training.distortion(t.rows, trained) < training.distortion(t.rows, fixed)
    cells = training.tree(t.rows, [4, 12], 2)
    assert [len(c) for c in cells.levels] == [4, 12] and cells.parents[1].tolist() == [i // 3 for i in range(12)]
    again = training.tree_em(t.rows, cells, 1)
    leaves = routing.descended(t.rows, again, [1], 1).groupBy("cell").count().collect()
    assert sum(r["count"] for r in leaves) == t.raw.count()
    mean, p = training.principal(t.raw, 8)
    assert np.allclose(p.T @ p, np.eye(8)) and np.allclose(mean, t.space.mean)


def test_codecs():
    r = np.random.default_rng(3)
    x = r.integers(-127, 128, (40, 8)).astype(float)
    codes = codecs.Product(r.normal(size=(4, 16, 2)) * 60).encode(x)
    assert (codecs.unpack(codecs.pack(codes)) == codes).all()
    book = codecs.Product(r.normal(size=(4, 16, 2)) * 60)
    for metric in ("ip", "l2"):
        near = book.decode(book.encode(x))
        want = -(x[:1] * near).sum(1) if metric == "ip" else ((x[:1] - near) ** 2).sum(1)
        table = np.repeat(book.table(x[:1], metric), len(x), 0)
        assert np.allclose(codecs.adc(table, book.encode(x)), want)
        assert np.argsort(codecs.adc(codecs.narrow(table, 16), book.encode(x)))[0] == np.argsort(want)[0]
    zero = codecs.Binary(np.eye(8), 1).encode(np.zeros((1, 8)))
    assert zero[1].tolist() == [0] and zero[2].tolist() == [0]
    u, cadd, cmul = codecs.Binary(codecs.random_rotation(8), 6).encode(x)
    s = codecs.Binary(codecs.random_rotation(8), 6).score(np.repeat(x[:1], 40, 0), u, cadd, cmul, "ip")
    assert np.corrcoef(s, -(x[:1] * x).sum(1))[0, 1] > 0.98


def test_descent_finds_the_neighbours(spark, t):
    found = graph.nn_descent(t.rows, 8)
    both = found.join(t.graph.select("src", "dst"), ["src", "dst"]).count()
    assert both >= 0.9 * t.graph.count()
    old = found.where("src < 400 and dst < 400")
    more = graph.nn_descent(t.rows, 8, frozen=old)
    assert ivf.same_results(more.where("src < 400"), old).first()[:] == (0, 0)
    assert more.where("src >= 400").join(t.graph.select("src", "dst"), ["src", "dst"]).count() >= 0.85 * t.graph.where("src >= 400").count()


def test_prune_same_as_brute_force(spark, t):
    x = {r.vec_id: np.array(r.nx, float) for r in t.rows.collect()}
    edges = {}
    for r in t.graph.collect():
        edges.setdefault(r.src, []).append(r.dst)
    got = {}
    for r in graph.pruned(t.graph, t.rows, 4, 1.2).collect():
        got.setdefault(r.src, {})[r.pos] = r.dst
    for v, found in edges.items():
        d = lambda a, b: ((x[a] - x[b]) ** 2).sum()
        order = sorted(found, key=lambda p: (d(v, p), p))
        taken, left = [], list(order)
        while left and len(taken) < 4:
            p = left.pop(0)
            taken.append(p)
            left = [q for q in left if 1.2**2 * d(p, q) > d(v, q)]
        taken += [q for q in order if q not in taken][: 4 - len(taken)]
        assert [got[v][i + 1] for i in range(len(taken))] == taken


def test_adaptive_probe(spark):
    r = np.random.default_rng(4)
    rows = [(q, int(p), int(q * 1000 + i), int(r.integers(0, 400) + 15 * p)) for q in range(4) for i, p in enumerate(r.integers(1, 15, 200))]
    places = spark.createDataFrame(rows, "qid long, place int, vec_id long, score long")
    for k, window, patience in ((10, 1, 2), (5, 2, 1), (10, 1, 50)):
        got = {x.qid: x.stop for x in adaptive.stops(places, k, window, patience).collect()}
        for q in range(4):
            seen, kth, stall, stop = [], None, 0, max(p for a, p, _, _ in rows if a == q)
            for place in range(1, stop + 1):
                seen = sorted(seen + [s for a, p, _, s in rows if a == q and p == place])
                if len(seen) >= k and place % window == 0:
                    stall = stall + 1 if kth is not None and seen[k - 1] >= kth else 0
                    kth = seen[k - 1]
                    if stall >= patience:
                        stop = place
                        break
            assert got[q] == stop


def test_presets():
    of = presets.Preset.of
    assert [of(n).name for n in ("loose", "default", "high")] == ["fast", "balanced", "accurate"]
    assert [of(target=x).name for x in (0.90, 0.95, 0.99)] == ["fast", "balanced", "accurate"]
    assert of("fast", 0.99).name == "fast" and of().name == "balanced"
    for bad in ({"target": 1.01}, {"name": "other"}):
        with pytest.raises(ValueError):
            of(**bad)
    ladder = lambda n, *a: of(n).probe_ladder(*a)
    assert ladder("balanced", 96, 65536, 10**7) == [4, 8, 16, 32] and ladder("balanced", 200, 4096, 10**7) == [1, 3, 6, 12]
    assert ladder("fast", 200, 16384, 10**7) == [4, 8, 16, 32] and ladder("balanced", 1024, 65536, 10**7) == [32, 64, 128, 256]
    assert ladder("balanced", 1024, 65536, 35 * 10**6) == [9, 19, 38, 76]
    assert [of(n).keep for n in ("fast", "balanced", "accurate")] == [16, 20, 48]
    assert of("balanced").pool_floor(10**7, 96) == 450 and of("balanced").pool_floor(35 * 10**6, 1024) == 500


def test_fits():
    points = [(r, 0.95 - 0.4 * 0.5 ** (r - 1)) for r in range(1, 8)]
    fit = evaluate.geometric_fit(points)
    assert abs(fit["ceiling"] - 0.95) < 1e-6 and abs(fit["contraction"] - 0.5) < 1e-6 and fit["rmse"] < 1e-9
    assert abs(evaluate.interpolated([(0.8, 100.0), (0.9, 1.0)], 0.85) - 10) < 1e-9 and evaluate.interpolated([(0.8, 1.0)], 0.5) is None
    assert math.isclose(codecs.percentile(np.array([[0] * 128 + [1, 3, 4] + [4] * 125]).reshape(1, 256), 0.5)[0], 1.0)
