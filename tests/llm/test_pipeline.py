import corpus_pipeline
from llm_words import prose
from test_decontam import brute as leaks
from test_mixing import verify
from test_neardup import brute as groups
from test_quality import brute as counts
from test_quality import plain_kept

from ripestream.llm import mixing
from ripestream.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        out = stage(step(spark, docs, SF), name)
        if name != "sharding":
            assert out.columns == columns and out.schema == docs.schema
        kept[name], docs = (before, out), out
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}

    before, after = (rows(d) for d in kept["quality"])
    for i, t in before.items():
        n, _, symbols, _, repeats = counts(t)
        if n < 10 or 100 * repeats > 20 * n:
            assert i not in after
        elif symbols > 2 * n:
            assert i not in after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, t in before.items() if labels.get(i) == 1 and counts(t)[0] >= 10 and 100 * counts(t)[4] <= 20 * counts(t)[0]]
    assert sum(i in after for i in clean) >= 0.95 * len(clean)

    before, after = (rows(d) for d in kept["near_duplicates"])
    assert set(after) == {c for _, _, c in groups(list(before.items()), 5)}

    before, after = (rows(d) for d in kept["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, _, hit, _ in leaks(list(before.items()), items) if not hit}

    before, after = kept["mixing"]
    plan = mixing.mix(before).collect()
    verify(plan, lambda want, longest: max(5, longest, 0.02 * want))
    copies = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in plan if r.copies}

    before, after = kept["sharding"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())
    assert set(after.columns) == {*columns, "shard", "slot"}


def test_run_over_the_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_through_every_stage(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties and repeated rows: every stage's rows, by exact result."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    given = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = spark.createDataFrame([(60, prose(61, 30) + " " + items[0][1] + " " + prose(62, 30), "en", "a", None), (60, prose(63, 40), "en", "a", None)], odd_docs.select(columns).schema)
    docs = stage(odd_docs.select(columns).unionByName(passage), "odd")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        seen[name] = (docs, docs := stage(step(spark, docs, SF), "odd"))

    before, after = map(given, seen["quality"])
    good = plain_kept([(i, *r[1:4]) for i, r in enumerate(before)])
    assert after == [r for i, r in enumerate(before) if good[i]] and 0 < len(after) < len(before)

    before, after = map(given, seen["near_duplicates"])
    assert sorted(((c, n) for _, n, c in groups([r[:2] for r in after], 5)), key=repr) == sorted({(c, n) for i, n, c in groups([r[:2] for r in before], 5) if i == c}, key=repr)
    assert len(after) < len(before) and all(r in before for r in after)

    before, after = map(given, seen["decontamination"])
    hit = {i: h > 0 for i, _, h, _ in leaks([(i, r[1]) for i, r in enumerate(before)], items)}
    assert after == [r for i, r in enumerate(before) if not hit[i]] and sum(hit.values()) == 1

    before, after = seen["mixing"]
    copies = [tuple(r[c] for c in columns) for r in mixing.mix(before).collect() for _ in range(r.copies)]
    assert given(after) == sorted(copies, key=repr)

    before, after = seen["sharding"]
    assert given(after.select(columns)) == given(before)
    for s in range(40):
        assert sorted(r.slot for r in after.where(f"shard = {s}").collect()) == list(range(after.where(f"shard = {s}").count()))

    docs = stage(no_docs.select(columns), "none")
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "none")
    assert docs.collect() == [] and docs.columns == [*columns, "shard", "slot"]


def test_one_row_of_each_group(spark):
    """Repeated ids with different texts, repeated rows and copies without an id: one row of each component, by exact result."""
    a, b, c, d, e, f = (prose(300 + i, 60) for i in range(6))
    rows = [(7, a), (7, b), (3, b + " end"), (8, a), (9, a + " end")]  # 7 stands for a's group, though its other text goes
    rows += [(20, c), (20, c), (20, c)] + [(None, d)] * 50 + [(None, e), (30, e), (None, e)] + [(40, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(7, a), (3, b + " end"), (20, c), (None, d), (30, e), (40, f)], key=repr)
    for given in (docs, stage(docs.repartition(5), "spread")):
        got = corpus_pipeline.one_of_each(spark, given, SF)
        assert got.schema == given.schema
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want
