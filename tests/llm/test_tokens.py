import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ripestream.llm import tokenfile, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def made(docs, frame_bytes=64):
    sink = io.BytesIO()
    out = tokenfile.Writer(sink, "<u2", frame_bytes)
    for i, ids in docs:
        out.add(i, np.array(ids, np.uint32))
    out.close()
    return sink.getvalue()


DOCS = [(None, [1]), (3, []), (4, list(range(500))), (9, [65535, 1]), (9, [7] * 40), (12, [2, 1])]


def test_round_trip_and_random_access():
    data = made(DOCS)
    back = [(i, start, ids.tolist()) for i, start, ids in tokenfile.Reader(Bytes(data)).documents()]
    starts = np.cumsum([0] + [len(x) for _, x in DOCS])
    assert back == [(i, int(s), x) for (i, x), s in zip(DOCS, starts)]
    reader = tokenfile.Reader(Bytes(data))
    assert [x[2].tolist() for x in reader.documents([5])] == [[2, 1]] and reader.decompressed == 1 and len(reader.entries) >= 3
    assert list(tokenfile.Reader(Bytes(made([]))).documents()) == []


def test_frames_are_plain_zstandard():
    import zstandard

    data = made(DOCS)
    out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    got = out.read(sum(2 * len(x) for _, x in DOCS))
    assert got == b"".join(np.array(x, "<u2").tobytes() for _, x in DOCS)


def test_a_flipped_byte_is_noticed():
    data = bytearray(made(DOCS))
    reader = tokenfile.Reader(Bytes(bytes(data)))
    data[int(reader.begins[1]) + 10] ^= 0xFF
    with pytest.raises(tokenfile.CorruptFrame):
        list(tokenfile.Reader(Bytes(bytes(data))).documents())
    assert [x[2].tolist() for x in tokenfile.Reader(Bytes(bytes(data))).documents([0])] == [[1]]  # other frames stay readable
    with pytest.raises(tokenfile.CorruptFrame):
        tokenfile.Reader(Bytes(bytes(data[:-1]) + b"\0"))


def test_ids_equal_those_of_the_whole_text(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(50, "don't <|endoftext|>x ΑΣ ς é ́b a\x1cc ½ ﬁ 日本語 'll 12 a's   z"), (51, "A" * 3000)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    tok = Tokenizer.from_file(PATH)
    want = sorted(((r.doc_id, np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect()), key=repr)
    manifest = tokens.write(docs, PATH)
    got = tokens.read(manifest).collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [len(r.ids) // 4 for r in ordered])[:-1].tolist()
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokens.read(tokens.write(no_docs, PATH)).count() == 0


def test_query(spark):
    from ripestream.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(PATH)
    start, want = 0, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, sf).collect()} == want


def test_another_tokenizer_encodes_whole_texts(spark):
    import base64

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.parts_suffice(open(PATH).read()) and not tokens.parts_suffice(open(other).read())
    texts = ["Hello  World, don't\n x", "", "UPPER lower 123 a1b2", "é — 你好 ", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = Tokenizer.from_file(other)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.read(tokens.write(docs, other)).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_one_id_over_many_texts_has_an_order(spark):
    """A third of the rows share an id: they stand in order of their texts' hash, in any layout, over several files."""
    from llm_words import prose
    from pyspark.sql import functions as F

    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, prose(i, 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one, many = (tokens.write(docs.repartition(n), PATH) for n in (1, 7))
        assert one.where("documents > 0").count() >= 4
        key = lambda m: [(r.doc_id, r.start, bytes(r.ids)) for r in tokens.read(m).orderBy("start").collect()]
        assert key(one) == key(many)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
