"""Tokens of two tokenizers aligned by their bytes, with corpus counts of linked id pairs.

Tokenizer A is a byte-level BPE file, B a sentencepiece model.  Both encode a
text behind one space.  Where tokens of both end at the same byte a group ends;
tokens whose bytes overlap are linked.  The count of an id pair is the number of
documents that hold it linked.

Neither tokenizer joins bytes across a single space between two solid characters
(A's pattern puts a space in front of what follows; no piece of B has a space
behind another character, which ``Aligner`` checks), so a text is cut there, and
a worker aligns a distinct segment once and keeps it; beyond ``CACHE_SEGMENTS``
it forgets those that came up in one piece of text only.

1. Tasks align their documents and write each pair with the number of their
   documents that hold it; Spark makes the pairs distinct over all tasks.
2. Tasks build minimal perfect hash functions of buckets of pairs (``perfect``).
3. With the functions, the tasks' numbers become dense vectors indexed by pair
   number, which are added in a tree: sixteen tasks each, then all.
4. A second pass re-aligns the documents and looks their pairs' counts up.

The functions, keys and counts of one block of pairs (4 M) are sent to the tasks
at a time: some 100 MB.  More pairs take a pass of steps 3 and 4 for each block,
and what a block gave a document is added up by the row's address.

Cases: null and empty texts, and texts whose tokens' bytes differ from the space
and the text (U+2581, which B reads as a space, or bytes that aren't UTF-8) have
no tokens: zeros, and '' for the digest; their pairs aren't counted.  Null and
repeated ids are rows like others: equal rows count as two documents.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripestream.llm import perfect
from ripestream.llm import text as tx
from ripestream.llm.common import addressed, stage

CACHE_SEGMENTS = 600_000
PIECE = 1 << 19
#: Segments given to the tokenizers at a time; distinct pairs of a task that it writes out together.
CALL, TASK_PAIRS = 8192, 1 << 20
#: Counters of a row while vectors are added; tasks that a first sum takes together.
VECTOR, FAN_IN = 1 << 16, 16
#: Characters of more than one byte that are white space for A's pattern: first bytes and the range of the last one.
_WIDE_SPACES = [(b"\xc2", 0x85, 0x85), (b"\xc2", 0xA0, 0xA0), (b"\xe1\x9a", 0x80, 0x80), (b"\xe2\x80", 0x80, 0x8A), (b"\xe2\x80", 0xA8, 0xA9), (b"\xe2\x80", 0xAF, 0xAF),
                (b"\xe2\x81", 0x9F, 0x9F), (b"\xe3\x80", 0x80, 0x80)]


class Segments(tx.Page):
    """Texts cut at single spaces between two solid characters; the space itself is left out."""

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        d, n = self.data, len(self.data)
        begins = self.offs[:-1][np.diff(self.offs) > 0]
        if n < 3:
            cut = np.zeros(0, np.int64)
        else:
            ends_solid, starts_solid = d > 0x20, d > 0x20
            for lead, low, high in _WIDE_SPACES:
                k = len(lead)
                here = (d[k:] >= low) & (d[k:] <= high)
                for i, b in enumerate(lead):
                    here &= d[i : n - k + i] == b
                at = np.flatnonzero(here)
                if len(at):
                    starts_solid, ends_solid = starts_solid.copy(), ends_solid.copy()
                    starts_solid[at], ends_solid[at + k] = False, False
            middle = (d[1:-1] == 0x20) & ends_solid[:-2] & starts_solid[2:]
            cut = np.flatnonzero(middle) + 1
            edge = np.isin(cut, self.offs) | np.isin(cut + 1, self.offs)  # the first or last byte of a text
            cut = cut[~edge]
        start = np.sort(np.concatenate([begins, cut + 1]))
        end = np.sort(np.concatenate([begins[1:], cut, [n] if len(begins) else []])).astype(np.int64)
        return start, end


def byte_of_char() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Alignments of distinct segments; a worker keeps one."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        char = byte_of_char()
        vocab = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            a_bytes[i] = bytes(char[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("tokenizer B has pieces with a space behind another character: texts can't be cut at spaces")
        self.bytes = (a_bytes, b_bytes)
        self.lengths = tuple(np.array([len(x) for x in table], np.int64) for table in self.bytes)
        # what stands for a token in a group's text: A's ids end in , or |, B's in , or ;
        names = [[str(i).encode() + end for i in range(len(table)) for end in (b",", last)] for table, last in zip(self.bytes, (b"|", b";"))]
        self.written, self.b_from = [*names[0], *names[1]], len(names[0])
        self.written_size = np.array([len(x) for x in self.written], np.int64)
        self.generation = 0
        self.reset()

    def reset(self) -> None:
        self.generation += 1
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int32)
        self.ok = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.first, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []  # kept only if ``with_groups``

    with_groups = False

    def want_groups(self) -> None:
        """From now on keep the groups' text, too; what was kept without it is forgotten."""
        if not self.with_groups:
            self.with_groups = True
            self.reset()

    def shrink(self) -> None:
        """Keep the segments met more than once, at most half of the cache; slots change."""
        least = max(2, int(np.sort(self.uses)[-min(len(self.uses), CACHE_SEGMENTS // 2)]) if len(self.uses) else 2)
        keep = np.flatnonzero(self.uses >= least)[: CACHE_SEGMENTS // 2]
        at, _ = self.links_of(keep)
        place = np.full(len(self.ok), -1, np.int64)
        place[keep] = np.arange(len(keep))
        moved = place[self.slots]
        self.hashes, self.slots = self.hashes[moved >= 0], moved[moved >= 0]
        self.links, self.sizes, self.ok = self.links[at], self.sizes[keep], self.ok[keep]
        self.uses = np.ones(len(keep), np.int32)
        self.first = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]
        self.groups = [self.groups[i] for i in keep.tolist()] if self.with_groups else []
        self.generation += 1

    def seen(self, page: Segments) -> np.ndarray:
        """Slot of every segment of ``page``; call ``shrink`` or ``reset`` before a page, never inside."""
        uniq, where, back = np.unique(page.words, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, uniq)
        old = spot < len(self.hashes)
        old[old] = self.hashes[spot[old]] == uniq[old]
        known = np.zeros(len(uniq), np.int64)
        known[old] = self.slots[spot[old]]
        new = np.flatnonzero(~old)
        if len(new):
            known[new] = len(self.ok) + np.arange(len(new))
            raw, (start, end) = page.data.tobytes(), page.spans
            self.add([raw[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist())])
            self.hashes, self.slots = np.insert(self.hashes, spot[new], uniq[new]), np.insert(self.slots, spot[new], known[new])
            self.uses = np.pad(self.uses, (0, len(new)))
        self.uses[known] += 1
        return known[back]

    def add(self, bodies: list[bytes]) -> None:
        for lo in range(0, len(bodies), CALL):
            self._add(bodies[lo : lo + CALL])

    def _add(self, bodies: list[bytes]) -> None:
        texts = [b.decode("utf-8", "replace") for b in bodies]
        tokens = ([e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1))
        full = [b" " + x for x in bodies]
        ok = np.ones(len(full), bool)
        if not all(self._spells(x, table, full) for x, table in zip(tokens, self.bytes)):
            ok = np.array([all(b"".join([table[i] for i in x[j]]) == t for x, table in zip(tokens, self.bytes)) for j, t in enumerate(full)])
            tokens = tuple([x if good else [] for x, good in zip(ids, ok)] for ids in tokens)
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in tokens]
        ends = [np.cumsum(size[x]) for size, x in zip(self.lengths, ids)]
        upto = np.cumsum(np.where(ok, np.fromiter(map(len, full), np.int64, len(full)), 0))  # where each segment ends, for both
        both = np.intersect1d(*ends, assume_unique=True)
        links = np.union1d(*ends)  # between two ends, one token of each
        self.links = np.concatenate([self.links, ids[0][np.searchsorted(ends[0], links)] << 32 | ids[1][np.searchsorted(ends[1], links)]])
        counts = np.stack([np.diff(np.searchsorted(x, np.r_[0, upto], side="right")) for x in (*ends, both, links)], axis=1)
        self.first = np.concatenate([self.first, len(self.links) - len(links) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.sizes, self.ok = np.concatenate([self.sizes, counts]), np.concatenate([self.ok, ok])
        if self.with_groups:
            # A's tokens of a group, then B's; the last of each side has its own end
            group = np.concatenate([np.searchsorted(both, x) for x in ends])
            side = np.repeat([0, 1], [len(x) for x in ids])
            word = 2 * np.concatenate(ids) + np.isin(np.concatenate(ends), both) + np.where(side, self.b_from, 0)
            word = word[np.argsort(2 * group + side, kind="stable")]
            text = b"".join([self.written[w] for w in word.tolist()])
            stop = np.r_[0, np.cumsum(self.written_size[word])][np.cumsum(counts[:, 0] + counts[:, 1])].tolist()
            self.groups += [text[x : max(x, y - 1)] for x, y in zip([0, *stop], stop)]  # without the last end

    @staticmethod
    def _spells(tokens: list[list[int]], table: list[bytes], full: list[bytes]) -> bool:
        """Every segment's tokens have the segment's bytes."""
        got = [b"".join([table[i] for i in x]) for x in tokens]
        return got == full

    def links_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``links``, index into ``slots``) of all links of the slots."""
        size = self.sizes[slots, 3]
        return np.repeat(self.first[slots] - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(slots)), size)


_READY: dict[int, Aligner] = {}


def aligner(a_json: str, b_model: bytes) -> Aligner:
    key = hash((a_json, b_model))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Aligner(a_json, b_model)
    return _READY[key]


@dataclass
class Sheet:
    """A piece of texts, aligned."""

    page: Segments
    slots: np.ndarray
    good: np.ndarray  # texts that have tokens


def sheets(own: Aligner, column: pa.Array) -> Iterator[tuple[int, int, Sheet]]:
    for lo, hi, data, offs in tx.pieces(column, PIECE):
        if len(own.ok) > CACHE_SEGMENTS:
            own.shrink()
        page = Segments(data, offs, tx.INKED)
        slots = own.seen(page)
        good = (page.counts > 0) & (np.bincount(page.doc[~own.ok[slots]], minlength=page.n) == 0)
        yield lo, hi, Sheet(page, slots, good)


def linked_pairs(texts: DataFrame, sent) -> DataFrame:
    """Step 1: (key, n) of each pair in every task: documents there that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sent.value)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            for _, _, s in sheets(own, batch.column(0)):
                doc = s.page.doc
                mine = np.unique(doc[s.good[doc]] * len(own.ok) + s.slots[s.good[doc]])  # a segment once a document
                at, whose = own.links_of(mine % len(own.ok))
                new, number = np.unique(own.links[at], return_inverse=True)
                pair = np.unique((mine // len(own.ok))[whose] * len(new) + number) % max(len(new), 1)  # a pair once a document
                merged, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, np.bincount(pair, minlength=len(new))]), minlength=len(merged)).astype(np.int64)
                keys = merged
                if len(keys) > TASK_PAIRS:
                    yield rows()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield rows()

    return texts.mapInArrow(run, "key long, n long")


class Sums:
    """What the links of each of an aligner's segments add: links that are their A id's best, counts; kept up with new segments."""

    def __init__(self, own: Aligner, block) -> None:
        self.own, self.generation = own, 0
        self.function, counts, best = block
        self.values = np.concatenate([np.stack([best, counts], axis=1).astype(np.int64), [[0, 0]]])  # the last row is for -1
        self.sums = np.zeros((0, 2), np.int64)

    def __call__(self) -> np.ndarray:
        own = self.own
        if self.generation != own.generation:
            self.generation, self.sums = own.generation, np.zeros((0, 2), np.int64)
        if len(self.sums) < len(own.ok):
            new = np.arange(len(self.sums), len(own.ok))
            at, _ = own.links_of(new)
            keys, back = np.unique(own.links[at], return_inverse=True)
            upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(self.values[self.function.numbers(keys)][back], axis=0)])
            stop = np.cumsum(own.sizes[new, 3])
            self.sums = np.concatenate([self.sums, upto[stop] - upto[stop - own.sizes[new, 3]]])
        return self.sums


def counted(pairs: DataFrame, block) -> DataFrame:
    """Step 3: (part, counts) of one block, added up over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = block.value
        total = np.zeros(len(function.keys), np.int64)
        for batch in batches:
            number, n = function.numbers(batch.column(0).to_numpy()), batch.column(1).to_numpy()
            np.add.at(total, number[number >= 0], n[number >= 0])
        yield from vectors(TaskContext.get().partitionId() // FAN_IN, {i: total[i * VECTOR : (i + 1) * VECTOR] for i in range(-(-len(total) // VECTOR))})

    return added(added(pairs.select("key", "n").mapInArrow(run, VECTORS), "part", "lane"), "part")


VECTORS = "lane long, part long, counts binary"


def vectors(lane: int, parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of the parts that count anything, in the narrowest whole numbers that hold them."""
    for part, v in parts.items():
        if v.any():
            narrow = v.astype(np.min_scalar_type(int(v.max())))
            yield pa.RecordBatch.from_arrays([pa.array([lane]), pa.array([part]), pa.array([bytes([narrow.itemsize]) + narrow.tobytes()])], names=["lane", "part", "counts"])


def wide(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, f"<u{counts[0]}", offset=1).astype(np.int64)


def added(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of the vectors that agree in ``by``; one vector is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for lane, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                key = (part, lane) if "lane" in by else (part, 0)
                if here is not None and key != here:
                    yield from vectors(here[1], {here[0]: total})
                    total = np.zeros(0, np.int64)
                here, v = key, wide(counts)
                total = v if not len(total) else total + v
        if here is not None:
            yield from vectors(here[1], {here[0]: total})

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, VECTORS)


FOUND = "doc_id long, file long, at long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(docs: DataFrame, sent, block, first: bool) -> DataFrame:
    """Step 4: sizes, digest (in the ``first`` block's pass) and what the pairs of one block add."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sent.value)
        own.want_groups()
        per_slot = Sums(own, block.value)
        for batch in batches:
            for lo, hi, s in sheets(own, batch.column(1)):
                table = np.concatenate([own.sizes, per_slot()], axis=1)[s.slots]
                sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(table, axis=0)])
                per_doc = np.where(s.good[:, None], sums[s.page.first[1:]] - sums[s.page.first[:-1]], 0)
                names, cut = s.slots.tolist(), s.page.first.tolist()
                sha = [hashlib.sha256(b";".join([own.groups[x] for x in names[cut[i] : cut[i + 1]]])).hexdigest() if good and first else "" for i, good in enumerate(s.good.tolist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in (0, 2, 3)], *[pa.array(np.ascontiguousarray(per_doc[:, c])) for c in range(6)], pa.array(sha, pa.string())],
                                                 names=["doc_id", "file", "at", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return docs.mapInArrow(run, FOUND)


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", block_keys: int = perfect.BLOCK_KEYS, bucket_keys: int = perfect.BUCKET_KEYS) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        sent = spark.sparkContext.broadcast((a.read(), b.read()))  # two vocabulary files
    known = addressed(docs, "aligned-documents", "__file", "__at").select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col("__file").alias("file"), F.col("__at").alias("at"))
    texts = known.select("text")
    pairs = stage(linked_pairs(texts, sent), "pairs")
    keys = stage(pairs.select("key").distinct(), "pair-keys")
    buckets = max(1, -(-keys.count() // bucket_keys))
    made = stage(perfect.functions(keys, buckets), "pair-functions", group_rows=16)
    each = max(1, block_keys // bucket_keys)  # buckets of a block
    best = np.zeros(1, np.int64)
    totals = []
    for low in range(0, buckets, each):
        rows = made.where(F.col("bucket").between(low, low + each - 1)).orderBy("bucket").collect()  # a block
        if not rows:
            continue
        function = perfect.Block(rows, buckets)
        block = spark.sparkContext.broadcast(function)
        total = stage(counted(pairs, block), "pair-counts")
        block.unpersist()
        counts = dense(total, len(function.keys))
        a = function.keys >> 32
        best = np.pad(best, (0, max(0, int(a.max()) + 1 - len(best))))  # a number for each id of A
        np.maximum.at(best, a, counts)
        totals.append((low, total))
    parts = []
    for low, total in totals or [(0, None)]:
        rows = made.where(F.col("bucket").between(low, low + each - 1)).orderBy("bucket").collect() if total is not None else []
        if rows:
            function = perfect.Block(rows, buckets)
            counts = dense(total, len(function.keys))
            block = spark.sparkContext.broadcast((function, counts, counts == best[function.keys >> 32]))
        else:  # no document has tokens
            block = spark.sparkContext.broadcast((NoPairs(), np.zeros(0, np.int64), np.zeros(0, bool)))
        part = looked_up(known, sent, block, not parts)
        if len(totals) > 1:
            part = stage(part, "looked-up")
            block.unpersist()
        parts.append(part)
    if len(parts) == 1:
        return parts[0].drop("file", "at")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    same = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return every.groupBy("file", "at").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256")).drop("file", "at")


class NoPairs:
    """The function of no keys."""

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        return np.full(len(keys), -1, np.int64)


def dense(total: DataFrame, n: int) -> np.ndarray:
    """Counts of one block by pair number."""
    out = np.zeros(n, np.int64)
    for r in total.select("part", "counts").collect():  # a block
        v = wide(r["counts"])
        out[r["part"] * VECTOR : r["part"] * VECTOR + len(v)] = v
    return out
