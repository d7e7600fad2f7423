import zlib

from llm_words import prose

from ripestream.llm import shards
from ripestream.llm.queries import QUERIES


def check(rows, n, tolerance):
    sizes = [0] * n
    slots = {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    share = sum(sizes) / n
    assert all(abs(s - share) <= tolerance for s in sizes), (sizes, share)


def test_equal_bytes_gapless_slots(spark):
    rows = spark.createDataFrame([(i, prose(i, 20 + i % 50)) for i in range(3000)], "doc_id long, text string")
    got = shards.shard(rows, 7).withColumn("size", shards.text_bytes("text")).collect()
    assert len(got) == 3000
    check(got, 7, 2 * max(r["size"] for r in got))
    where = lambda d: sorted((r.doc_id, r.shard) for r in shards.shard(d, 7).collect())
    assert where(rows) == where(rows.repartition(5))


def test_a_third_of_the_rows_are_copies(spark):
    rows = spark.createDataFrame([(i, "same text " * 20 if i % 3 == 0 else prose(i, 30)) for i in range(2000)], "doc_id long, text string")
    got = shards.shard(rows, 10).withColumn("size", shards.text_bytes("text")).collect()
    check(got, 10, 2 * max(r["size"] for r in got))
    copies = [r["shard"] for r in got if r["text"].startswith("same")]
    assert max(copies) - min(copies) + 1 == len(set(copies))  # neighbours in the order


def test_equal_rows_are_spread(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i, "same " * 20 if i % 3 == 0 else prose(i, 20)) for i in range(3000)], "doc_id long, text string")
    got = shards.shard(rows.repartition(3), 10).withColumn("size", shards.text_bytes("text")).collect()
    check(got, 10, 4 * max(r["size"] for r in got))


def test_columns_in_other_case_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a", "x", "y", 3, 4)], "doc_id long, text string, Shard string, SLOT string, __key int, __file int")
    got = shards.shard(rows, 3)
    assert got.columns == ["doc_id", "text", "__key", "__file", "shard", "slot"] and tuple(got.first())[2:4] == (3, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    got = shards.shard(odd_docs, 4).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["shard"] < 4 for r in got)
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert [c for c in shards.shard(odd_docs).columns if c == "shard"] == ["shard"]
    assert shards.shard(no_docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_sharding"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    check(got, 40, 2 * max(r["size"] for r in got))
