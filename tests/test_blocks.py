"""Products in blocks against brute force; nothing that grows with the number of products may be shuffled."""

import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from arrayloom.operators import encodings, linalg
from arrayloom.plans import blocks
from arrayloom.plans.einsum import MIN_PLUS, einsum
from arrayloom.tensor import SparseTensor

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _made_in_blocks(df):
    plan = _plan(df)
    assert "MapInArrow" in plan and "REPARTITION_BY" in plan and "_r#" not in plan, plan


def _entries(rng, rows, columns, n, boolean=False, nulls=True):
    out = {}
    for _ in range(n):
        place = rng.choice(rows), rng.choice(columns)
        out[place] = None if nulls and rng.random() < 0.1 else rng.random() < 0.5 if boolean else float(rng.randrange(-9, 10))
    return [(*p, v) for p, v in out.items()]


def _frame(spark, rows, boolean=False):
    return SparseTensor(spark.createDataFrame(rows, f"i long, j long, v {'boolean' if boolean else 'double'}"), ("i", "j"))


def _brute(a, b, name):
    groups = defaultdict(list)
    rows = defaultdict(list)
    for k, j, w in b:
        if k is not None:
            rows[k].append((j, w))
    for i, k, v in a:
        for j, w in rows[k] if k is not None else ():
            if name == "or_and":
                groups[i, j].append(False if v is False or w is False else None if v is None or w is None else True)
            else:
                groups[i, j].append(None if v is None or w is None else v * w if name == "sum_product" else v + w)
    fold = {"sum_product": sum, "min_plus": min, "or_and": any}[name]
    return {p: fold(good) if (good := [x for x in g if x is not None]) else None for p, g in groups.items()}


def _dict(df):
    rows = df.collect()
    out = {(r[0], r[1]): r[2] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", ["sum_product", "min_plus", "or_and"])
@pytest.mark.parametrize("order", ["k", "i"])
def test_product_is_brute_force(spark, name, order, monkeypatch):
    monkeypatch.setattr(blocks, "ENTRIES", 100)  # several blocks
    monkeypatch.setattr(blocks, "CELLS", 1)  # several groups of rows
    rng = random.Random(name + order)
    boolean = name == "or_and"
    free = [None, -(2**62), -65, -64, -1, *range(0, 200, 7), 2**62]
    k = [None, *range(-5, 40)]
    a, b = _entries(rng, free, k, 600, boolean), _entries(rng, k, free, 600, boolean)
    got = _dict(blocks.product(_frame(spark, a, boolean), _frame(spark, b, boolean), name, order))
    assert got == _brute(a, b, name)


@pytest.mark.parametrize("name", ["sum_product", "min_plus"])
def test_worker_small_pieces_and_sparse_groups(name, monkeypatch):
    """A group's accumulator is the same whether dense, sparse or merged, and whatever the batches."""
    rng = random.Random(3)
    a, b = _entries(rng, range(90), range(20), 500), _entries(rng, range(20), range(300), 900)
    right = sorted((0, 0, 0, k, j, w) for k, j, w in ((k, j, w if w is not None else math.inf) for k, j, w in b))
    right = [(*r[:5], None if r[5] == math.inf else r[5]) for r in right]
    stored = {k for k, _, _ in b}
    left = sorted(((0, 1, i >> 4, k, i, v) for i, k, v in a if k in stored), key=lambda r: r[:5])
    names = ["block", "side", "g", "x", "y", "v"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    want = _brute(a, b, name)
    for products, most, cells, size in ((1 << 18, 1 << 25, 1 << 22, 10_000), (7, 1 << 25, 1 << 22, 13), (50, 0, 20, 100)):
        monkeypatch.setattr(blocks, "PRODUCTS", products)
        monkeypatch.setattr(blocks, "MOST_CELLS", most)
        monkeypatch.setattr(blocks, "CELLS", cells)
        rows = right + left
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[x : x + size]), types)], names=names) for x in range(0, len(rows), size)]
        got = [r for out in blocks._multiply(iter(batches), name, 4, False) for r in zip(*[c.to_pylist() for c in out.columns])]
        assert {(i, j): v for i, j, v in got} == want and len(got) == len(want)


def test_not_a_number_and_empty(spark):
    a = _frame(spark, [(0, 0, math.nan), (0, 1, 1.0), (1, 0, math.nan)])
    b = _frame(spark, [(0, 0, 1.0), (1, 0, 2.0)])
    low = _dict(einsum("ik,kj->ij", a, b, semiring=MIN_PLUS, blocked=True).df)
    assert low[0, 0] == 3.0 and math.isnan(low[1, 0])
    none = _frame(spark, [])
    for x, y in ((a, none), (none, b), (none, none)):
        assert einsum("ik,kj->ij", x, y, blocked=True).df.count() == 0


def test_sampled_product(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ENTRIES", 100)
    rng = random.Random(5)
    a = _entries(rng, range(70), range(70), 900)
    ab = _brute(a, a, "sum_product")
    want = {(i, j): None if v is None or ab[i, j] is None else v * ab[i, j] for i, j, v in a if (i, j) in ab}
    t = _frame(spark, a)
    assert _dict(blocks.product(t, t, order="i", sampled=True)) == want


def test_types_that_blocks_do_not_carry_are_joined(spark):
    t = SparseTensor(spark.createDataFrame([(0, 0, 2**60 + 1)], "i long, j long, v long"), ("i", "j"))
    assert einsum("ik,kj->ij", t, t, semiring=MIN_PLUS, blocked=True).df.collect()[0][2] == 2**61 + 2


@pytest.mark.parametrize("name", ["mm", "triangle_unfused", "mm_checksum", "spgemm_gustavson", "spgemm_min_plus", "spgemm_outer", "spgemm_or_and"])
def test_queries_shuffle_no_products(spark, name):
    _made_in_blocks(__spark_entry__.queries()[name](spark, SF))


def test_band_of_a_long_column_stays_short(spark, monkeypatch):
    """Two entries a million rows apart: a band in one piece had a million places."""
    upper = _frame(spark, [(0, 2_000_000, 2.0), (1_000_000, 2_000_000, 3.0), (1_000_002, 2_000_000, 5.0)])
    assert encodings.encode(upper, "band").agg(F.max(F.size("val"))).first()[0] == 1_000_003
    pieces = encodings.encode(upper, "band", strip=linalg.STRIP)
    assert sorted(r["val"] for r in pieces.collect()) == [[2.0], [3.0, 0.0, 5.0]]
    x = SparseTensor(spark.createDataFrame([(0, 1.0), (1_000_000, 10.0), (1_000_002, 100.0), (2_000_000, 1000.0)], "j long, v double"), ("j",))
    d = SparseTensor(spark.createDataFrame([(0, 7.0)], "i long, v double"), ("i",))
    made = []
    monkeypatch.setattr(linalg, "encode", lambda *a, **b: made.append(encodings.encode(*a, **b)) or made[-1])
    y = linalg.spmv_symmetric(upper, d, x, "band")
    assert {r["i"]: r["v"] for r in y.df.collect()} == {0: 2007.0, 1_000_000: 3000.0, 1_000_002: 5000.0, 2_000_000: 532.0}
    assert [df.agg(F.max(F.size("val"))).first()[0] for df in made] == [3]
