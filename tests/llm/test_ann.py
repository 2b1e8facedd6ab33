import numpy as np
from pagemill.llm.ann import ORACLE, nearest, quantise, tile_bounds
from pyspark.sql import functions as F

from tests.llm.oracle import same


def brute(rows, k):
    out = []
    fine = [(i, np.array(e, float)) for i, e in rows if i is not None and e is not None and all(x is not None for x in e) and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float) != 0)]
    for i, a in fine:
        if i % 20 == 0:
            near = sorted(((-float(np.cumsum(a * b)[-1]), j) for j, b in fine if j != i and len(a) == len(b)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def test_brute_force(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal(8)
    rows = [(i, (g.standard_normal(8) if i % 3 else base).astype(np.float32).astype(float).tolist()) for i in range(400)]
    rows += [(420, None), (440, [0.0] * 8), (460, [1.0] * 7 + [None]), (480, [float("nan")] + [1.0] * 7), (500, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (520, [1.0, 2.0]), (540, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks in ({}, {"query_block": 7, "vector_block": 90}):
        got = nearest(df.where(F.col("vec_id") % 20 == 0), df, k=5, **blocks).collect()
        want = brute(rows, 5)
        assert sorted(map(tuple, got)) == want


def test_bounds_hold():
    g = np.random.default_rng(4)
    a, b = g.standard_normal((50, 33)), g.standard_normal((60, 33)) * 10.0 ** g.integers(-6, 6, (60, 1))
    low, high = tile_bounds(quantise(a), quantise(b))
    assert (low <= a @ b.T).all() and (a @ b.T <= high).all()
    assert np.median(high - low) < np.median(np.abs(a @ b.T))


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty, empty).count() == 0
    one = spark.createDataFrame([(20, [1.0], 1), (20, [1.0], 1), (3, [2.0], 5)], "vec_id long, embedding array<float>, rank int")
    assert [(r.query_id, r.vec_id) for r in nearest(one.where("vec_id = 20").limit(1), one).collect()] == [(20, 3)]


def test_oracle(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    same(nearest(df.where("vec_id % 20 = 0"), df), ORACLE, sf)
