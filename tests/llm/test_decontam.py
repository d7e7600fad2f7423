import re

from ripestream.llm import decontam
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if x := windows.get(tuple(w[i : i + size])):
                    found |= x
                    hit[i : i + size] = [1] * size
        out.append((doc_id, len(w), sum(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, odd_docs, no_docs):
    from llm_words import prose

    bench = [(1, prose(4, 400)[100:400]), (2, "One, TWO!"), (3, None), (4, ""), (None, prose(5, 40)), (5, "x x x"), (6, "!!"), (7, prose(4, 400)[100:400]), (7, "é"), (8, prose(1, 25))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(docs, bench)
    for blocks in (500_000, 40):
        got = decontam.scan(odd_docs, items, block_windows=blocks).collect()
        assert sorted(((r.doc_id, r.leaks.n_words, r.leaks.n_hit, list(r.leaks["items"])) for r in got), key=repr) == want
    for r in got:
        assert sum(s.end - s.start for s in r.leaks.spans) == r.leaks.n_hit
    assert decontam.scan(no_docs, items).count() == 0
    assert decontam.scan(odd_docs, items.limit(0)).where("leaks.n_hit > 0").count() == 0


def test_partial_containment(spark):
    base = [f"w{i}" for i in range(10)]
    changed = base[:9] + ["other"]
    docs = spark.createDataFrame([(1, " ".join(["p", *base, "q"])), (2, " ".join(["p", *changed, "q"])), (3, "p q r s t u v w x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(base))], "item_id long, text string")
    hits = lambda share: {r.doc_id for r in decontam.scan(docs, items, share=share).collect() if r.leaks.n_hit}
    assert hits(1.0) == {1}
    assert hits(0.8) == {1, 2}  # 5 of 6 shingles


def test_whole_table(spark):
    from ripestream.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    import hashlib

    want = {d: (n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_decontamination"](spark, sf).collect()}
    assert got == want and any(v[-1] for v in want.values())


def test_several_blocks_give_the_rows_of_one(spark, odd_docs):
    """Spans of different blocks that touch or overlap become one; the columns stay the same."""
    from llm_words import prose

    whole = prose(4, 400).split()
    bench = [(i, " ".join(whole[i * 7 : i * 7 + 20])) for i in range(40)] + [(99, "one two")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    one, many = (decontam.scan(odd_docs, items, block_windows=n) for n in (500_000, 60))
    assert one.columns == many.columns and one.schema["leaks"].dataType == many.schema["leaks"].dataType
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(one) == rows(many) and sum(r.leaks.n_hit > 0 for r in one.collect()) >= 4
