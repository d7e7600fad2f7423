import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_words import prose
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ripestream.llm import aligned, perfect

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, file string, at int, key string"
TEXTS = [
    prose(1, 300), "two  spaces and\ttabs\n\n new lines ", " leading", "trailing ", "   ", "\n", "x", "naïve café — “quotes” ½ 你好 世界 🙂🙂 é", "no break   em　wide x  y  z",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b and ▁ more", "don't we'll I'd 've 12345 67.89 a1b2 --- !!! http://x.y/z?q=1&r=2", "tab\t \tmix  \n x", "​ zero ﻿ bom", "A" * 700 + " b", "é" * 50,
    prose(2, 40) + " " + prose(1, 30), "\x00\x01 control \x7f", "fi ﬁ ﬂ Ａ", "a b", "a b ", " a b", "a  b  c",
]


def expected(texts):
    """Whole-text encoding and alignment, one token at a time."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    char = aligned.byte_of_char()
    of_a = {i: bytes(char[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    docs = []
    for t in texts:
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        ba = [of_a[i] for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            docs.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(i) for i, e in zip(ia, ea) if p < e <= end) + "|" + ",".join(str(i) for i, e in zip(ib, eb) if p < e <= end))
            p = end
        for i, (x, e) in enumerate(zip(ia, ea)):
            s = ea[i - 1] if i else 0
            links += [(x, y) for j, (y, f) in enumerate(zip(ib, eb)) if max(s, eb[j - 1] if j else 0) < min(e, f)]
        docs.append((len(ia), len(ib), groups, links))
    counts = Counter(pair for d in docs if d for pair in set(d[3]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]),
            hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_equals_whole_text_alignment(spark, monkeypatch, blocks):
    rows = [(i, t, "f", 1, "k") for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (None, "", "f", 1, "k"), (0, TEXTS[0], "f", 1, "k"), (0, TEXTS[0], "f", 1, "k")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    few = {"block_keys": 128, "bucket_keys": 64} if blocks == "many" else {}
    got = result(aligned.align(df, A, B, **few))
    assert got == sorted(((r[0], *x) for r, x in zip(rows, expected([r[1] for r in rows]))), key=str)


def test_small_cache_and_pieces_change_nothing(spark, monkeypatch):
    own = aligned.Aligner(open(A).read(), open(B, "rb").read())
    import pyarrow as pa

    own.want_groups()
    column = pa.array(TEXTS)
    whole = [(s.good.tolist(), [own.groups[x] for x in s.slots]) for _, _, s in aligned.sheets(own, column)]
    monkeypatch.setattr(aligned, "PIECE", 40)
    own.reset()
    parts = []
    for _, _, s in aligned.sheets(own, column):
        parts.append((s.good.tolist(), [own.groups[x] for x in s.slots]))
        own.reset()
    assert [x for p in parts for x in p[0]] == [x for p in whole for x in p[0]] and [x for p in parts for x in p[1]] == [x for p in whole for x in p[1]]


def test_forgetting_rare_segments_changes_nothing(spark, monkeypatch):
    texts = TEXTS + [prose(i, 60) for i in range(30)] + TEXTS
    df = spark.createDataFrame([(i, t, "f", 1, "k") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    want = result(aligned.align(df, A, B))
    own = aligned.Aligner(open(A).read(), open(B, "rb").read())
    own.want_groups()
    import pyarrow as pa

    groups = lambda: [[own.groups[x] for x in s.slots[s.page.first[i] : s.page.first[i + 1]]] for _, _, s in aligned.sheets(own, pa.array(texts)) for i in range(s.page.n)]
    whole = groups()
    monkeypatch.setattr(aligned, "PIECE", 600)
    monkeypatch.setattr(aligned, "CACHE_SEGMENTS", 150)
    own.reset()
    first = own.generation
    assert groups() == whole and own.generation > first + 5
    assert [r[1:] for r in want] == [r[1:] for r in sorted(((i, *x) for i, x in enumerate(expected(texts))), key=str)]


def test_empty_table_and_no_tokens(spark):
    assert aligned.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert result(aligned.align(spark.createDataFrame([(1, None, "", 0, ""), (2, "▁", "", 0, "")], SCHEMA), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash_is_minimal_and_verified(spark):
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 60, 30_000))
    rows = perfect.functions(spark.createDataFrame([(int(k),) for k in keys], "key long"), 7).orderBy("bucket").collect()
    whole = perfect.Block(rows, 7)
    numbers = whole.numbers(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys))) and (whole.keys[numbers] == keys).all()
    foreign = np.setdiff1d(rng.integers(0, 1 << 60, 5000), keys)
    assert (whole.numbers(foreign) == -1).all()
    first, rest = perfect.Block(rows[:3], 7), perfect.Block(rows[3:], 7)
    assert ((first.numbers(keys) >= 0) ^ (rest.numbers(keys) >= 0)).all() and len(first.keys) + len(rest.keys) == len(keys)
