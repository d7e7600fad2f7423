import numpy as np
import pytest
from pyspark.sql import functions as F

from ripestream.llm import hilbert as hb

SCHEMA = "vec_id long, embedding array<float>, row int, node string, rank int"


def made(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", 2) for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, ids, k, asked):
    """{place of the query's row: [(vec_id, score)]} over rows in the given order."""
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for q in range(len(ids)):
        if asked(ids[q]):
            found = sorted((-float(np.dot(x[q], x[c])), ids[c]) for c in range(len(ids)) if c != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("axes,bits", [(2, 5), (3, 4), (8, 2)])
def test_the_curve_visits_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    key = hb.hilbert_keys(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("norms", ["unit", "mixed"])
def test_a_reach_over_all_rows_is_exact(spark, norms):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * (1 if norms == "unit" else rng.uniform(0.1, 9, (300, 1)))
    got = result(hb.search(made(spark, v).repartition(4), F.col("vec_id") % 20 == 0, k=7, reach=1000, block=64))
    want = brute(v, list(range(300)), 7, lambda i: i % 20 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(s - t) < 1e-9 for q in got for (_, s), (_, t) in zip(got[q], want[q]))


def test_measured_reach_finds_its_share(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(60, 16)) * 3
    v = middles[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.4
    df = made(spark, v)
    got = result(hb.search(df, F.col("vec_id") % 20 == 0, k=10))
    want = brute(v, list(range(4000)), 10, lambda i: i % 20 == 0)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 10 * len(want) and all(len(x) == 10 for x in got.values())


def test_narrow_windows_do_for_clusters(spark):
    rng = np.random.default_rng(10)
    middles = rng.normal(size=(100, 16))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    v = (middles[np.arange(4000) % 100] + rng.normal(size=(4000, 16)) * 0.01).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = brute(v, list(range(4000)), 10, lambda i: i % 101 == 0)
    got = result(hb.search(made(spark, v), F.col("vec_id") % 101 == 0, k=10, reach=200, block=128))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_a_third_of_the_rows_share_a_vector(spark):
    rng = np.random.default_rng(11)
    v = np.r_[rng.normal(size=(200, 6)), np.tile(rng.normal(size=(1, 6)), (100, 1))]
    ids = [int(i) for i in rng.permutation(300)]
    got = result(hb.search(made(spark, v, ids), F.col("vec_id") % 5 == 0, k=8, reach=1000))
    want = brute(v, ids, 8, lambda i: i % 5 == 0)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {ids[q]: [i for i, _ in x] for q, x in want.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1, 0], None, [nan, 1], [inf, 1], [0, 0], [None, 1], [1, 0, 0], [], [0.5, 0.5], [1, 0], [0.25, 0], [3, 3]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, 160, 0, 7, None]
    got = hb.search(made(spark, v, ids), F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(
        2 * [(0, 1, 0, 1.0), (0, 2, 160, 0.5), (0, 3, 7, 0.25)] + [(160, 1, 0, 0.5), (160, 2, 0, 0.5), (160, 3, 7, 0.125)])
    assert hb.search(made(spark, []), F.lit(True)).collect() == [] and hb.search(made(spark, [[1, 2]], [3]), F.lit(False)).collect() == []
    assert hb.search(made(spark, [[1, 2]], [3]), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
