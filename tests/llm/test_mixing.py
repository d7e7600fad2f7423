import re
from fractions import Fraction

import numpy as np
from llm_words import prose

from ripestream.llm import mixing
from ripestream.llm.queries import QUERIES


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    """sizes: {source: words}; the level rises until nobody is above the cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > limit * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(limit * sizes[s])
            open_.remove(s)
        left = Fraction(sum(sizes.values())) - sum(out.values())
    return {s: float(v) for s, v in out.items()}


def verify(rows, near):
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(want[s], longest[s]), (s, taken[s], want[s])


def test_targets_are_met_and_capped(spark):
    rows = [(i, prose(i, 1 + i % 90), "a" if i % 10 else "b") for i in range(2000)] + [(5000 + i, prose(i, 40), "c") for i in range(60)] + [(9000 + i, prose(i, 12), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(docs).collect()
    verify(first, lambda want, longest: max(5, 0.01 * want))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_rates_are_tilted_by_size(spark):
    docs = spark.createDataFrame([(i, prose(i, 10 + i % 100), "a") for i in range(1500)] + [(9000 + i, prose(i, 50), "b") for i in range(1500)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    small, large = ([r["copies"] for r in got if r["source"] == "a" and lo <= r["size"] < lo + 30] for lo in (10, 80))
    assert sum(large) / len(large) > sum(small) / len(small) + 0.1  # a is to grow: its log-odds rise with size


def test_tilts_solve_the_dual(spark):
    """Newton's tilts equal those that bisection finds for each source."""
    rng = np.random.default_rng(5)
    pairs, plan, want = [], [], {}
    for key, factor in (("up", 1.9), ("down", 0.2), ("same", 1.0), ("near", 2.95), ("full", 3.0), ("none", 0.0)):
        sizes = np.unique(np.concatenate([rng.integers(1, 400, 60), [20_000]]))
        n = rng.integers(1, 50, len(sizes))
        words, docs = int((sizes * n).sum()), int(n.sum())
        pairs += [(key, int(x), int(y)) for x, y in zip(sizes, n)] + [(key, 0, 4)]
        plan.append((key, key, words, docs + 4, words * factor))
        if 0 < factor < 3:
            z, lo, hi = sizes / (words / (docs + 4)), -60.0, 60.0
            for _ in range(200):
                mid = (lo + hi) / 2
                rate = 3 / (1 + 2 * np.exp(np.clip(-mid * z, -600, 600)))
                lo, hi = (mid, hi) if (rate * sizes * n).sum() < words * factor else (lo, mid)
            want[key] = lo
    frame = spark.createDataFrame(pairs, "key string, size long, n long")
    got = {r.key: r for r in mixing.balance(frame, spark.createDataFrame(plan, "key string, source string, source_size long, docs long, target double")).collect()}
    assert got["full"].full and got["none"].none and not got["near"].full
    for key, tilt in want.items():
        assert abs(got[key].tilt - tilt) < 1e-5 * max(1, abs(tilt)), (key, got[key].tilt, tilt)


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, prefix="m_").collect()
    assert len(got) == odd_docs.count() and got[0]["size"] == "z"
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.m_size == n and r.m_taken == r.m_copies * n and 0 <= r.m_copies <= 3
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    verify(QUERIES["op8_mixing"](spark, sf).join(docs, "doc_id").collect(), lambda want, longest: max(5, 0.02 * want))
