import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripestream.llm import veccodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(vectors, parts, entries, rounds):
    """Codes, errors and codebooks of integer vectors in the order of their ids, by comparing everything."""
    v = vectors.reshape(len(vectors), parts, -1).astype(object)
    books = [[list(v[i, p]) for i in range(min(entries, len(v)))] for p in range(parts)]

    def near(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p])) for x in v[:, p]]

    for _ in range(rounds):
        for p in range(parts):
            own = near(p)
            for k in range(len(books[p])):
                mine = [v[i, p] for i, (_, e) in enumerate(own) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [near(p) for p in range(parts)]
    return [bytes(last[p][i][1] for p in range(parts)) for i in range(len(v))], [sum(last[p][i][0] for p in range(parts)) for i in range(len(v))], books


def made(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, [float(x) for x in v], 0, "x", 1) for i, v in zip(ids, vectors)], SCHEMA)


@pytest.mark.parametrize("kind", ["random", "ties", "tight", "one"])
def test_equals_comparing_everything(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(vc, "LEAF", 4)
    v = {"random": rng.normal(size=(600, 8)), "ties": rng.integers(-1, 2, (600, 8)) / 4, "tight": np.r_[rng.normal(size=(80, 8)), np.repeat(rng.normal(size=(4, 8)), 130, 0) + rng.normal(size=(520, 8)) / 300], "one": np.full((300, 8), 0.3)}[kind]
    v = v.astype(np.float32)
    df, books = vc.encode(made(spark, v).repartition(3), parts=4, entries=13, rounds=2)
    got = {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in df.collect()}
    code, error, want = brute(vc.whole(v, 256), 4, 13, 2)
    assert got == {i: x for i, x in enumerate(zip(code, error))}
    assert books.tolist() == want
    assert vc.digest(books) == hashlib.sha256(",".join(str(x) for p in want for e in p for x in e).encode()).hexdigest()


def test_whole_nodes_are_assigned_by_cached_sums():
    rng = np.random.default_rng(1)
    entries = rng.normal(size=(16, 4)) * 4000
    points = (entries[rng.integers(0, 16, 5000)] + rng.normal(size=(5000, 4))).astype(np.int32)
    entries = entries.astype(np.int64)
    depth = vc.depth_of(len(points))
    points = points[vc.grow(points, depth)]
    lo, hi, total, count = vc.leaves_of(points, depth)
    levels, tree = vc.levels_of(lo, hi, total, count), vc.EntryTree.of(entries)
    done, leaf, _ = vc.walk(levels, tree, entries)
    whole = sum(levels[i].count[n].sum() for i, n, _ in done)
    assert whole > 4500 and len(np.unique(leaf)) < 1 << depth  # most parts were decided by bounds
    own = ((points[:, None, :].astype(np.int64) - entries) ** 2).sum(2).argmin(1)
    assert (vc.chosen(points, levels, tree, entries) == own).all()
    n, s = vc.gathered(points, levels, tree, entries)
    assert n.tolist() == np.bincount(own, minlength=16).tolist() and (s == [points[own == k].sum(0) for k in range(16)]).all()


def test_several_chunks_give_the_same(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=(900, 8)).astype(np.float32)
    once, books = vc.encode(made(spark, v).coalesce(1), parts=2, entries=20)
    monkeypatch.setattr(vc, "CHUNK", 64)
    many, more = vc.encode(made(spark, v).repartition(5), parts=2, entries=20)
    key = lambda df: sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in df.collect())
    assert key(once) == key(many) and (books == more).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.1] * 8, 1, "c", 7), (None, [0.2] * 8, None, None, None), (5, [0.1] * 8, 1, "c", 7), (3, None, 1, "c", 7), (2, [nan] + [0.1] * 7, 1, "c", 7), (1, [inf] * 8, 1, "c", 7),
            (0, [None] + [0.1] * 7, 1, "c", 7), (6, [0.1] * 4, 1, "c", 7), (7, [], 1, "c", 7), (8, [1e30] * 8, None, "c", 7)]
    df, books = vc.encode(spark.createDataFrame(rows, SCHEMA).coalesce(1), parts=2, entries=3)
    got = sorted(((r["vec_id"], r["label"], bytes(r["code"])) for r in df.collect()), key=str)
    assert got == sorted([(5, 1, b"\1\1"), (5, 1, b"\1\1"), (None, None, b"\0\0"), (8, None, b"\2\2")], key=str) and books[0, 2].tolist() == [vc.LIMIT] * 4
    assert df.columns == ["vec_id", "label", "code", "error"]
    total = {(r["vec_id"], r["label"]): r["t"] for r in vc.with_group_error(df.where("vec_id is null or vec_id <> 5"), "label", "t").collect()}
    assert total == {(None, None): total[(8, None)], (8, None): total[(8, None)]}
    none, books = vc.encode(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vc.encode(made(spark, np.ones((2, 6))), parts=4)


def test_same_name_in_other_case(spark):
    df = made(spark, np.random.default_rng(2).normal(size=(9, 4))).select("vec_id", "embedding", F.lit(1).alias("Code"), F.lit(2).alias("ERROR"), F.lit(3).alias("n"), F.lit(4).alias("c0"))
    got, _ = vc.encode(df, parts=2, entries=4)
    assert got.columns == ["vec_id", "n", "c0", "code", "error"] and {(r["n"], r["c0"]) for r in got.collect()} == {(3, 4)}
