"""Benchmark passages in documents by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` words (a shorter item is
one window).  A window is the set of its ``SHINGLE``-word shingles.  Shingles
are ordered by rarity, counted over all documents; a document that contains at
least ``share`` of a window's n shingles has at least one of its
n - ceil(share * n) + 1 rarest ones, so only those prefix shingles are joined
with the documents' shingles.  A match at word p of a shingle that stands at
offset o puts the window at words p - o: positions before the text or beyond
its end are dropped (length and positional bounds), and what is left is
verified over the item-sized window, word by word for ``share`` = 1.

The benchmark is a query set.  It is read in blocks of at most
``BLOCK_WINDOWS`` windows, each sent to the tasks as one sorted array.  Several
blocks are taken one after the other: a pass writes the spans and items of the
documents that a block hits, by row address, and lets go of the block; the written
rows are merged and joined to the documents.  So no more than one block is held by
the driver or a task, and documents are never shuffled.

Cases: null or empty texts have no words, hits or items.  Items without words
are ignored; an item with a null id marks words but isn't named or counted.
Repeated items count once by id; repeated documents are scanned one by one.  An
empty benchmark leaves every document clean.  ``scan`` returns the input's
columns and adds one struct column, by default ``leaks``; a column of that name
in the input is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.llm import text as tx
from ripestream.llm.common import addressed, inner_prefix, stage

WINDOW, SHINGLE = 10, 5
BLOCK_WINDOWS = 500_000
#: Bits of the table that sorts out most shingles before the exact search.
SIEVE = 1 << 20

LEAKS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


class Windows:
    """Distinct windows of one benchmark block: word hashes, length, items of each."""

    def __init__(self, ids: list[int | None], texts: pa.Array, window: int, shingle: int) -> None:
        found: dict[bytes, set[int | None]] = {}
        for lo, _, data, offs in tx.pieces(texts):
            page = tx.Page(data, offs, tx.ALNUM, lower=True)
            for i in range(page.n):
                words = page.words[page.first[i] : page.first[i + 1]]
                for at in range(max(1, len(words) - window + 1) if len(words) else 0):
                    found.setdefault(words[at : at + window].tobytes(), set()).add(ids[lo + i])
        keys = sorted(found)
        self.size = np.array([len(k) // 8 for k in keys], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.words = np.frombuffer(b"".join(keys), np.uint64)
        named = [sorted(x for x in found[k] if x is not None) for k in keys]
        self.item_first = np.concatenate([[0], np.cumsum([len(x) for x in named], dtype=np.int64)])
        self.items = np.array([x for v in named for x in v], np.int64)
        self.k = np.minimum(self.size, shingle)
        # all shingles of all windows: owner window, offset, hash, length
        parts = []
        for k in np.unique(self.k):
            sel = np.flatnonzero(self.k == k)
            firsts = np.concatenate([[0], np.cumsum(self.size[sel])])
            words = np.concatenate([self.words[self.first[w] : self.first[w + 1]] for w in sel])
            h, at = tx.grams(words, firsts, int(k))
            own = np.searchsorted(firsts, at, side="right") - 1
            parts.append((h, sel[own], at - firsts[own]))
        self.s_hash, self.s_window, self.s_offset = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.int64)))

    def prefixes(self, seen: dict[int, int], share: float) -> "Windows":
        """Keep only the rarest shingles that a match can't miss, sorted by hash."""
        order = np.lexsort((self.s_hash, [seen.get(h, 0) for h in self.s_hash.tolist()], self.s_window))
        h, w, o = self.s_hash[order], self.s_window[order], self.s_offset[order]
        total = np.bincount(w, minlength=len(self.size))
        rank = np.arange(len(w)) - np.concatenate([[0], np.cumsum(total)])[w]
        keep = rank < (total - np.ceil(share * total).astype(np.int64) + 1)[w]
        h, w, o = h[keep], w[keep], o[keep]
        order = np.argsort(h, kind="stable")
        self.s_hash, self.s_window, self.s_offset = h[order], w[order], o[order]
        return self


class Sieve:
    """Membership of hashes in a sorted array, most of it by one table look-up."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.table = np.zeros(SIEVE, bool)
        self.table[(hashes % np.uint64(SIEVE)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(h & np.uint64(SIEVE - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        spot = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[spot] == h[maybe]]


def shingle_counts(docs: DataFrame, text: str, hashes: np.ndarray, lengths: list[int]) -> dict[int, int]:
    """How often each of the given shingles stands in all documents."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(np.unique(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sieve(sent.value)
        total = np.zeros(len(known.hashes), np.int64)
        for batch in batches:
            for _, _, data, offs in tx.pieces(batch.column(0)):
                page = tx.Page(data, offs, tx.ALNUM, lower=True)
                for k in lengths:
                    h, _ = page.grams(k)
                    h = h[known.hits(h)]
                    total += np.bincount(np.searchsorted(known.hashes, h), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.hashes[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    got = docs.select(F.col(text)).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # at most a row for each shingle of the block
    return {int(np.int64(r[0]).view(np.uint64)): r[1] for r in got}


def search(page: tx.Page, block: Windows, sieve: Sieve, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a page."""
    found_w, found_s = [], []
    for k in np.unique(block.k):
        h, at = page.grams(int(k))
        sel = sieve.hits(h)
        if not len(sel):
            continue
        h, at = h[sel], at[sel]
        lo, hi = np.searchsorted(block.s_hash, h, side="left"), np.searchsorted(block.s_hash, h, side="right")
        reps = hi - lo
        idx = np.repeat(lo, reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        w, start = block.s_window[idx], np.repeat(at, reps) - block.s_offset[idx]
        doc = np.repeat(page.doc[at], reps)
        fits = (block.k[w] == k) & (start >= page.first[doc]) & (start + block.size[w] <= page.first[doc + 1])
        found_w.append(w[fits])
        found_s.append(start[fits])
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.stack([np.concatenate(found_w), np.concatenate(found_s)], axis=1), axis=0)
    w, start = pair[:, 0], pair[:, 1]
    # verify over the item-sized window
    for size in np.unique(block.size[w]):
        own = np.flatnonzero(block.size[w] == size)
        span = np.arange(size)
        for part in np.array_split(own, len(own) // 200_000 + 1):
            same = page.words[start[part][:, None] + span] == block.words[block.first[w[part]][:, None] + span]
            if share < 1:
                k = int(min(size, block.k[w[part]].max()))
                runs = np.lib.stride_tricks.sliding_window_view(same, k, axis=1).all(axis=2)
                w[part[runs.sum(axis=1) < math.ceil(share * runs.shape[1])]] = -1
            else:
                w[part[~same.all(axis=1)]] = -1
    return w[w >= 0], start[w >= 0]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks",
         window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0, block_windows: int = BLOCK_WINDOWS, drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (sorted ids), spans (merged word ranges that are hit)."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    words = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0  # at least the number of windows
    n = -(-words // block_windows)

    def block_of(b: int):
        """Windows of one block, sent to the tasks; None if it has none."""
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).toArrow()
        made = Windows(part.column("id").to_pylist(), part.column("text").combine_chunks(), window, shingle)
        if not len(made.size):
            return None
        return sc.broadcast(made.prefixes(shingle_counts(docs, text, made.s_hash, [int(k) for k in np.unique(made.k)]), share))

    if n <= 1:
        return scanned(docs, text, out, drop_text, block_of(0) if n else None, share)
    p = inner_prefix(docs)
    rows = addressed(docs, "leak-documents", f"{p}file", f"{p}at")
    texts = rows.select(F.col(text).alias("text"), F.col(f"{p}file").alias("file"), F.col(f"{p}at").alias("at"))
    parts = []
    for b in range(n):
        block = block_of(b)
        if block is not None:
            parts.append(stage(scanned(texts, "text", "leaks", True, block, share).where("leaks.n_hit > 0").select("file", "at", "leaks.items", "leaks.spans"), "leaks"))
            block.unpersist()
    counted = scanned(rows, text, out, drop_text, None, share)
    if not parts:
        return counted.drop(f"{p}file", f"{p}at")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    both = every.groupBy("file", "at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = stage(both.mapInArrow(joined_spans, T.StructType([*both.schema.fields, T.StructField("n_hit", T.LongType())])), "leaks").select(
        F.col("file").alias(f"{p}file"), F.col("at").alias(f"{p}at"), F.struct("n_hit", "items", "spans").alias(f"{p}hit"))
    found = counted.join(merged, [f"{p}file", f"{p}at"], "left")
    hit = F.col(f"{p}hit")
    full = F.when(hit.isNull(), F.col(out)).otherwise(F.struct(F.col(out)["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"), hit["items"].alias("items"), hit["spans"].alias("spans")))
    return found.select(*[c for c in counted.columns if c not in (out, f"{p}file", f"{p}at")], full.alias(out))


def joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans (file, at, items, spans) with those that touch made one, and the number of words in them."""
    for batch in batches:
        spans, hits = [], []
        for own in batch.column(3).to_pylist():
            out: list[dict] = []
            for s in own:
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            spans.append(out)
            hits.append(sum(s["end"] - s["start"] for s in out))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, batch.column(3).type), pa.array(hits, pa.int64())], names=["file", "at", "items", "spans", "n_hit"])


def scanned(docs: DataFrame, text: str, out: str, drop_text: bool, block, share: float) -> DataFrame:
    """``docs`` with the struct ``out`` of one block (or of none)."""
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower() and not (drop_text and f.name == text)]
    schema = T.StructType([*kept, T.StructField(out, LEAKS)])
    spot, wanted = docs.columns.index(text), [i for i, f in enumerate(docs.schema.fields) if f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = (block.value, Sieve(np.unique(block.value.s_hash))) if block is not None else None
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(spot)):
                leaks = found_in(tx.Page(data, offs, tx.ALNUM, lower=True), ready, share)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in wanted], leaks], names=schema.names)

    return docs.mapInArrow(run, schema)


def found_in(page: tx.Page, ready: tuple[Windows, Sieve] | None, share: float) -> pa.Array:
    """The struct of each text of a page."""
    total = len(page.words)
    edge = np.zeros(total + 1, np.int64)
    named_doc, named_item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if ready is not None:
        block, sieve = ready
        w, start = search(page, block, sieve, share)
        if len(w):
            edge += np.bincount(start, minlength=total + 1) - np.bincount(start + block.size[w], minlength=total + 1)
            many = block.item_first[w + 1] - block.item_first[w]
            idx = np.repeat(block.item_first[w], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            named_doc.append(np.repeat(page.doc[start], many))
            named_item.append(block.items[idx])
    covered = np.cumsum(edge)[:total] > 0
    c = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
    n_hit = c[page.first[1:]] - c[page.first[:-1]]
    pairs = np.unique(np.stack([np.concatenate(named_doc), np.concatenate(named_item)], axis=1), axis=0)
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(page.n + 1)).astype(np.int32)), pa.array(pairs[:, 1]))
    # merged spans, cut at text boundaries
    head, tail = covered.copy(), covered.copy()
    head[1:] &= ~covered[:-1]
    tail[:-1] &= ~covered[1:]
    cut = page.first[(page.first > 0) & (page.first < total)]
    head[cut], tail[cut - 1] = covered[cut], covered[cut - 1]
    s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
    base = page.first[page.doc[s]] if len(s) else s
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, page.first).astype(np.int32)),
                                     pa.StructArray.from_arrays([pa.array((s - base).astype(np.int64)), pa.array((e - base).astype(np.int64))], names=["start", "end"]))
    return pa.StructArray.from_arrays([pa.array(page.counts.astype(np.int64)), pa.array(n_hit), items, spans], names=["n_words", "n_hit", "items", "spans"])
