import random
import re
from itertools import combinations

from llm_words import prose

from ripestream.llm import neardup
from ripestream.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k):
    """(doc_id, n, component) of every row; rows are the nodes."""
    sets = [shingles(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        low = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), low) for i in own]
    return sorted(out, key=repr)


def edited(text, edits, r):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = neardup.cluster(odd_docs, k=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.cluster(no_docs).count() == 0


def test_groups_chains_and_near_misses(spark):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = prose(100 + g, 120)
        rows += [(1000 * g, base), (1000 * g + 1, base.upper())]
        rows += [(1000 * g + 10 + i, edited(base, e, r)) for i, e in enumerate((1, 2, 3, 4, 5, 6, 8))]
        chain = base
        for i in range(6):  # neighbours are similar, ends are not
            chain = edited(chain, 3, r)
            rows.append((1000 * g + 100 + i, chain))
    rows += [(90_000 + i, " ".join(prose(777, 40).split()[:30]) + " " + prose(i, 25)) for i in range(40)]  # a shared passage
    r.shuffle(rows)
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows, 4)


def test_shared_and_missing_ids(spark):
    """A third of the rows without an id, a third under one id: rows are told apart by their place."""
    r = random.Random(9)
    rows = []
    for g in range(60):
        base = prose(2000 + g, 60)
        rows += [(None, base), (5, edited(base, 1, r)), (1000 + g, edited(base, 1, r)), (None, prose(5000 + g, 50)), (5, prose(7000 + g, 50))]
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute(rows, 4)
    assert sum(x.chosen for x in got) == len(brute(rows, 4)) - 2 * 60


def test_values_are_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    both = np.concatenate([shared, a, shared, b])
    sig = neardup.signatures(both, np.array([0, 900]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 98), (7, 7), (None, 3)], "x long, y long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {98: 98, 99: 98, 100: 98}
    assert components(links.limit(0)).count() == 0
