"""Algebraic properties and numpy comparisons of the engine's operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.operators import analytics, encodings, graph, linalg, raster
from arrayloom.plans.einsum import MIN_PLUS, einsum
from arrayloom.sources import generate, matrix_market
from arrayloom.tensor import SparseTensor, difference_norm, equal


def dense(t, shape):
    out = np.full(shape, t.fill)
    for r in t.coo().collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def tensor(spark, a):
    a = np.asarray(a, float)
    rows = [(*map(int, ix), float(a[ix])) for ix in zip(*np.nonzero(a))]
    axes = ("i", "j")[: a.ndim]
    return SparseTensor(spark.createDataFrame(rows, ", ".join(f"{x} long" for x in axes) + ", v double"), axes, a.shape)


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (12, 9)) * (rng.random((12, 9)) < 0.4)
    b = rng.integers(0, 4, (9, 7)) * (rng.random((9, 7)) < 0.4)
    return a.astype(float), b.astype(float)


def test_einsum_matches_numpy(spark, pair):
    a, b = pair
    x, y = tensor(spark, a), tensor(spark, b)
    assert np.array_equal(dense(einsum("ij,jk->ik", x, y), (12, 7)), a @ b)
    assert einsum("ij,jk->", x, y).df.first()[0] == (a @ b).sum()
    assert np.array_equal(dense(einsum("ij->j", x), (9,)), a.sum(0))
    plain = einsum("ij,jk->", x, y, preaggregate=False).df.first()[0]
    assert plain == (a @ b).sum()


def test_einsum_rejects_wrong_shapes(spark, pair):
    a, b = pair
    with pytest.raises(ValueError):
        einsum("ij,jk->ik", tensor(spark, a), tensor(spark, a))
    with pytest.raises(ValueError):
        einsum("ij->k", tensor(spark, a))
    with pytest.raises(ValueError):
        einsum("ijk->i", tensor(spark, a))


def test_min_plus(spark):
    a = np.array([[0, 3, 8], [2, 0, 1], [4, 7, 0]], float) + 1
    t = tensor(spark, a)
    got = dense(einsum("ik,kj->ij", t, t, semiring=MIN_PLUS), (3, 3))
    assert np.array_equal(got, (a[:, :, None] + a[None, :, :]).min(1))


@pytest.mark.parametrize("method", ["inner", "gustavson", "outer"])
def test_spgemm(spark, pair, method):
    a, b = pair
    assert np.array_equal(dense(linalg.spgemm(tensor(spark, a), tensor(spark, b), method), (12, 7)), a @ b)


@pytest.mark.parametrize("fmt", [f for f in encodings.FORMATS if not f.startswith("point")])
def test_encodings_round_trip_and_spmv(spark, pair, fmt):
    a, _ = pair
    stored = (a != 0).astype(float) if fmt in encodings.PATTERNS else a
    t, x = tensor(spark, a), tensor(spark, np.arange(1.0, 10))
    assert np.array_equal(dense(encodings.decode(encodings.encode(t, fmt, 4), fmt, a.shape, 4), a.shape), stored)
    y = linalg.spmv(t, x.rename("j"), fmt, block=4)
    assert np.array_equal(dense(y, (12,)), stored @ np.arange(1.0, 10))
    if fmt not in ("blocked", "csr", "dcsr", "dense"):
        assert np.array_equal(dense(linalg.spmv(t, x.rename("j"), fmt, True), (12,)), stored @ np.arange(1.0, 10))
        s = np.triu(a[:9, :9]) + np.triu(a[:9, :9], 1).T
        s = (s != 0).astype(float) if fmt in encodings.PATTERNS else s
        u = tensor(spark, s)
        if fmt != "pattern":
            assert np.array_equal(dense(linalg.spmv_symmetric(u.upper(), u.diagonal(), x.rename("j"), fmt), (9,)), s @ np.arange(1.0, 10))


def test_rows_of_the_shape(spark):
    t = tensor(spark, [[0, 0, 0], [1, 0, 2], [0, 0, 0]])
    rows = lambda f: {r.i: (list(r.idx), list(r.val)) for r in encodings.encode(t, f).collect()}
    assert rows("dcsr") == {1: ([0, 2], [1, 2])} and rows("csr") == {0: ([], []), 1: ([0, 2], [1, 2]), 2: ([], [])}
    assert {r.i: list(r.val) for r in encodings.encode(t, "dense").collect()} == {0: [0, 0, 0], 1: [1, 0, 2], 2: [0, 0, 0]}


def test_spmv_shapes(spark, pair):
    with pytest.raises(ValueError):
        linalg.spmv(tensor(spark, pair[0]), tensor(spark, np.ones(4)))


def test_point_rejects_two_entries(spark):
    with pytest.raises(Exception, match="several entries"):
        encodings.encode(tensor(spark, [[1, 0], [2, 3]]), "point").collect()


def test_symmetric_spmv(spark):
    a = np.array([[2, 1, 0], [1, 0, 3], [0, 3, 5]], float)
    t, x = tensor(spark, a), tensor(spark, np.array([1.0, 2, 3])).rename("j")
    assert np.array_equal(dense(linalg.spmv_symmetric(t.upper(), t.diagonal(), x), (3,)), a @ [1, 2, 3])


def test_structure(spark, pair):
    a, _ = pair
    t = tensor(spark, a)
    assert np.array_equal(dense(t.transpose().transpose(), a.shape), a)
    s = a[:7, :7]
    assert np.array_equal(dense(tensor(spark, s).symmetrise(), s.shape), s + s.T)
    assert np.array_equal(dense(t.add(t), a.shape), a + a)
    assert np.array_equal(dense(t.mul(t), a.shape), a * a)
    assert equal(t, t).first()[0] and difference_norm(t, t).first()[0] == 0
    assert t.norm().first()[0] == pytest.approx(np.linalg.norm(a))


def test_empty_tensor(spark):
    t = tensor(spark, np.zeros((3, 3)))
    assert t.sum().first()[0] == 0
    assert einsum("ij,jk->", t, t).df.first()[0] == 0
    assert linalg.triangle_count(t).first()[0] == 0
    assert linalg.triangle_count_oriented(t).first()[0] == 0


def test_triangles(spark):
    a = np.zeros((6, 6))
    for i, j in [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5)]:
        a[i, j] = a[j, i] = i + j
    t, expected = tensor(spark, a), float(np.einsum("ij,jk,ik->", a, a, a))
    b = (a > 0).astype(int)
    assert linalg.triangle_intersect(t).first()[0] == np.einsum("ij,jk,ik->", b, b, b)
    assert linalg.triangle_count(t).first()[0] == expected == linalg.triangle_count_oriented(t).first()[0]


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs] + [(b, a, float(w)) for a, b, w in pairs], "src long, dst long, w double")


def test_bfs_and_sssp(spark):
    e = _edges(spark, [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (3, 4, 1), (7, 8, 1)])
    for alpha in (0.01, 2):
        found = graph.bfs(e, 0, alpha)
        assert {r.v: (r.level, r.parent) for r in found.collect()} == {0: (0, 0), 1: (1, 0), 2: (1, 0), 3: (2, 1), 4: (3, 3)}
        assert graph.bfs_check(e, found).first()[0] == 0
    dist = graph.sssp(e, 0)
    assert {r.v: r.dist for r in dist.collect()} == {0: 0, 1: 3, 2: 1, 3: 8, 4: 9}
    assert {r.v: r.parent for r in graph.sssp_parents(e, dist, 0).collect()} == {0: None, 1: 2, 2: 0, 3: 1, 4: 3}


def test_long_path_checks_and_components(spark):
    n = 40  # more rounds than are kept apart
    e = _edges(spark, [(k, k + 1, k % 3 + 1) for k in range(n)] + [(100, 101, 1), (102, 103, 1), (103, 101, 1)])
    tree, dist = graph.bfs(e, 0), graph.sssp(e, 0)
    assert {r.v: r.level for r in tree.collect()} == {k: k for k in range(n + 1)}
    assert {r.v: r.dist for r in dist.collect()} == {k: float(sum(i % 3 + 1 for i in range(k))) for k in range(n + 1)}
    found = graph.sssp_parents(e, dist, 0)
    assert tuple(graph.sssp_check(e, found, dist).first()) == (0, 0)
    bad = found.select("v", (F.col("dist") + (F.col("v") == 7).cast("int")).alias("dist"), F.when(F.col("v") == 9, 3).otherwise(F.col("parent")).alias("parent"))
    assert tuple(graph.sssp_check(e, bad, dist).first()) == (1, 1)
    assert tuple(graph.sssp_check(e, found.where("v <> 5"), dist).first()) == (1, 0)
    assert graph.bfs_check(e, tree.withColumn("parent", F.when(F.col("v") == 9, 3).otherwise(F.col("parent")))).first()[0] == 1
    roots = {r.v: r.root for r in graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert roots == {**{k: 0 for k in range(n + 1)}, **{k: 100 for k in range(100, 104)}}


def test_negative_cycle(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, -3.0), (2, 1, 1.0)], "src long, dst long, w double")
    with pytest.raises(ValueError):
        graph.sssp(e, 0)


def _image(spark, a):
    return spark.createDataFrame([(int(y), int(x), int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y long, x long, p long")


def _array(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r.p
    return out


def _erode(a, n):
    for _ in range(n):
        p = np.pad(a, 1, constant_values=1)
        a = np.min([p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    return a


@pytest.mark.parametrize("times", [1, 3])
def test_erosions_agree(spark, times):
    a = (np.random.default_rng(3).random((11, 70)) < 0.93).astype(int)
    a[4] = 0
    img, expected = _image(spark, a), _erode(a, times)
    assert np.array_equal(_array(raster.erode(img, times), a.shape), expected)
    for skip in (False, True):
        got = raster.bit_unpack(raster.erode_bits(raster.bit_pack(img), 70, times, skip_empty=skip), 70)
        assert np.array_equal(_array(got, a.shape), expected)
    runs = raster.rle_encode(img, fill=0).select("y", "x0", "x1")
    got = raster.rle_decode(raster.erode_runs(runs, 70, 11, times).withColumn("p", F.lit(1)))
    assert np.array_equal(_array(got, a.shape), expected)


def test_runs_and_bits_round_trip(spark):
    a = (np.random.default_rng(4).random((5, 40)) < 0.5).astype(int)
    img = _image(spark, a)
    assert np.array_equal(_array(raster.rle_decode(raster.rle_encode(img)), a.shape), a)
    assert np.array_equal(_array(raster.bit_unpack(raster.bit_pack(img), 40), a.shape), a)


def test_flood_fill(spark):
    a = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 1, 0, 1], [1, 0, 1, 1]])
    for method in ("runs", "frontier"):
        got = {(r.y, r.x) for r in raster.flood_fill(_image(spark, a), (0, 0), method).collect()}
        assert got == {(0, 0), (0, 1), (1, 1), (2, 1), (2, 0), (3, 0)}
        assert raster.flood_fill(_image(spark, a), (1, 0), method).count() == 0
    ragged = (np.random.default_rng(7).random((30, 30)) < 0.62).astype(int)
    ragged[0, 0] = 1
    one, other = ({(r.y, r.x) for r in raster.flood_fill(_image(spark, ragged), (0, 0), m).collect()} for m in ("runs", "frontier"))
    assert one == other


def test_magnify_cubic(spark):
    flat = np.full((4, 5), 100)
    assert (_array(raster.magnify_cubic(_image(spark, flat), 3), (12, 15)) == 100).all()
    a = np.random.default_rng(8).integers(0, 256, (5, 6))
    out = _array(raster.magnify_cubic(_image(spark, a), 2), (10, 12))
    w = lambda d: np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, np.where(d < 2, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3, 0))

    def matrix(n):
        m = np.zeros((2 * n, n))
        for o in range(2 * n):
            at = (o + 0.5) / 2 - 0.5
            for k in range(int(np.floor(at)) - 1, int(np.floor(at)) + 3):
                m[o, min(max(k, 0), n - 1)] += w(abs(at - k))
        return m

    assert np.abs(out - np.clip(matrix(5) @ a @ matrix(6).T, 0, 255)).max() <= 0.5 + 1e-6


def test_blur_stencil_alpha(spark):
    a = np.random.default_rng(5).integers(0, 256, (6, 8))
    p = np.pad(a, 1)
    s = sum(p[dy : dy + 6, dx : dx + 8] for dy in range(3) for dx in range(3))
    assert np.array_equal(_array(raster.blur(_image(spark, a)), a.shape), np.round(s / 9).astype(int))
    b = 255 - a
    assert np.array_equal(_array(raster.alpha_blend(_image(spark, a), _image(spark, b)), a.shape), np.round((a + b) / 2).astype(int))
    runs = raster.alpha_blend_runs(raster.rle_encode(_image(spark, a)), raster.rle_encode(_image(spark, b)))
    assert np.array_equal(_array(raster.rle_decode(runs), a.shape), np.round((a + b) / 2).astype(int))
    assert raster.histogram(_image(spark, a)).agg(F.sum("n")).first()[0] == a.size


def test_generators(spark):
    p = dense(generate.permutation(spark, 50, seed=2), (50, 50))
    assert (p.sum(0) == 1).all() and (p.sum(1) == 1).all()
    k = dense(generate.kron_ones(tensor(spark, [[1, 0], [0, 2]]), 2), (4, 4))
    assert np.array_equal(k, np.kron([[1, 0], [0, 2]], np.ones((2, 2))))
    b = dense(generate.banded(spark, 8, 2), (8, 8))
    assert b[3, 4] == 2 and b[4, 3] == 0 and b[0, 3] == 0


def test_matrix_market(spark, tmp_path):
    a = np.array([[0, 2.5, 0], [1, 0, 0], [0, 0, -4]])
    matrix_market.write_matrix(tensor(spark, a), str(tmp_path / "a"))
    assert np.array_equal(dense(matrix_market.read_matrix(spark, str(tmp_path / "a")), a.shape), a)
    f = tmp_path / "s.mtx"
    f.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% note\n3 3 2\n2 1\n3 3\n")
    assert np.array_equal(dense(matrix_market.read_matrix(spark, str(f)), (3, 3)), [[0, 1, 0], [1, 0, 0], [0, 0, 1]])
    f.write_text("%%MatrixMarket matrix coordinate complex general\n2 2 3\n1 1 2 9\n1 1 3 9\n2 2 3 1\n")
    assert np.array_equal(dense(matrix_market.read_matrix(spark, str(f)), (2, 2)), [[5, 0], [0, 3]])
    assert np.array_equal(dense(matrix_market.read_matrix(spark, str(f), "first"), (2, 2)), [[2, 0], [0, 3]])
    f.write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n2 2 2\n1 1 7\n")
    assert np.array_equal(dense(matrix_market.read_matrix(spark, str(f)), (2, 2)), [[7, 0], [0, 2]])
    f.write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 7\n")
    with pytest.raises(ValueError):
        matrix_market.read_matrix(spark, str(f))
    assert {r.i: list(r.val) for r in matrix_market.read_matrix(spark, str(tmp_path / "a"), encoding="dense").collect()} == {0: [0, 2.5, 0], 1: [1, 0, 0], 2: [0, 0, -4]}
    img = np.array([[5, 5, 0, 0], [0, 0, 0, 7], [1, 2, 2, 2]])
    matrix_market.write_runs(_image(spark, img), str(tmp_path / "r"))
    lines = sorted(line for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines() if line[0] != "%")
    assert lines == sorted(["3 4 6", "1 1 5", "1 3 0", "2 1 0", "2 4 7", "3 1 1", "3 2 2"])
    assert np.array_equal(_array(matrix_market.read_runs(spark, str(tmp_path / "r")), img.shape), img)
    matrix_market.write_vector(tensor(spark, np.array([1.0, 0, 3])), str(tmp_path / "v"))
    assert np.array_equal(dense(matrix_market.read_vector(spark, str(tmp_path / "v")), (3,)), [1, 0, 3])


def test_analytics(spark, tmp_path):
    rows = [("a", "m1", 1.0), ("b", "m1", 2.0), ("a", "m2", 4.0), ("b", "m2", 1.0)]
    r = spark.createDataFrame(rows, "method string, matrix string, time double")
    assert {(x.method, x.matrix): x.speedup for x in analytics.speedup_over(r, "a").collect()}[("b", "m1")] == 0.5
    g = {(x.method, x.other): x.geomean for x in analytics.speedup_all_pairs(r).collect()}
    assert g[("a", "b")] == pytest.approx(math.sqrt(2 * 0.25))
    assert {x.matrix: x.method for x in analytics.best_method(r).collect()} == {"m1": "a", "m2": "b"}
    for k in (1, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"method": "a", "matrix": f"m{k}", "time": 1.0 * k}]))
    assert analytics.load_results(spark, str(tmp_path / "1.json"), str(tmp_path / "2.json")).count() == 2
    analytics.save_results(r, str(tmp_path / "saved"))
    assert sorted(map(tuple, analytics.load_results(spark, str(tmp_path / "saved"), lines=True).select("method", "matrix", "time").collect())) == sorted(rows)
    b = analytics.batch(spark.range(10), 3, "id")
    assert [x.batch for x in b.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_whole_tables(spark):
    from arrayloom import queries as core

    data = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{data}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    assert core.QUERIES["tensor_sum"](spark, data).first()[0] == float(total)
    assert not any("l_quantity <=" in q or "c_custkey %" in q for q in core.SQL.values())


def test_bfs_query_is_not_capped(spark, tmp_path):
    from arrayloom import queries as core

    rows = [(1, k, k, 5.0) for k in range(1, 19)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert core.QUERIES["bfs_levels"](spark, str(tmp_path)).agg(F.max("level")).first()[0] == 17
