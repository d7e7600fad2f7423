"""Documents as token-id files, written and read by Spark tasks.

Documents are sorted by id across files (null ids first), each task encodes its
range and streams it into one file (see ``tokenfile``) in a shared folder.  The
rows that a successful task returns form the manifest, so the file of a lost or
repeated attempt is never read.

Every text is encoded with the ``tokenizers`` library.  A tokenizer that drops
white space, ignores case and never joins an ASCII letter with ASCII punctuation
or digits gives a text the ids of its parts (``Parts``), and a worker encodes each
distinct part once (``CACHE_PARTS`` of them are kept).  Pieces that hold the start
of a special token's name are cut at white space only, in their own case.  Whether
a tokenizer is of that kind is read from its own normalizer and pre-tokenizer
(``parts_suffice``); texts of any other tokenizer are encoded whole.

Cases: null and empty texts give the end id alone.  Repeated ids are written
next to each other, in order of a hash of their texts, and may go on in the next
file.  An empty table writes no file and reads
back empty.  Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripestream.llm import text as tx
from ripestream.llm import tokenfile
from ripestream.llm.common import stage
from ripestream.session import scratch_path

CACHE_PARTS = 1_500_000
#: Larger pieces than elsewhere: a part that repeats is looked up once in each.
PIECE = 1 << 20
END = 1

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
#: ASCII punctuation and digits; an apostrophe may belong to the letters behind it.
_OTHER = (_BYTES < 128) & ~_LETTER & (_BYTES != 39) & tx.INKED
_OTHER_OR_QUOTE = _OTHER | (_BYTES == 39)


class Parts(tx.Page):
    """White-space separated words, cut again where an ASCII letter meets ASCII punctuation or a digit."""

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        start, end = tx.Page.spans.func(self)
        d = self.data
        if len(d) < 2:
            return start, end
        cut = (_LETTER[d[:-1]] & _OTHER_OR_QUOTE[d[1:]]) | (_OTHER[d[:-1]] & _LETTER[d[1:]])
        at = np.flatnonzero(cut) + 1
        at = at[~np.isin(at, self.offs)]  # not between two texts
        return np.sort(np.concatenate([start, at])), np.sort(np.concatenate([end, at]))


def filesystem(uri: str):
    """(file system, path) of a folder given as a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


# The steps of a tokenizer for which parts suffice, as its file names them (fixed values).
PART_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_suffice(tokenizer_json: str) -> bool:
    """The tokenizer's ids of a text are those of its parts: white space is dropped, case ignored, and letters, digits and the rest are apart."""
    import json

    spec = json.loads(tokenizer_json)
    normalizer, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = cut.get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": PART_PATTERN}, "behavior": "Removed", "invert": True}
    plain = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
    marks = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return normalizer.get("normalizers") == PART_NORMALIZERS and steps[0] == split and plain and marks


class Encoder:
    """Ids of whole texts, from the ids of their parts if those suffice."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # the name of a special token is looked for before anything else
        self.names = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_parts = parts_suffice(tokenizer_json)
        self.reset()

    def reset(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool = np.full(1, END, np.uint32)  # slot 0 is the end of a document
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), ends included."""
        if not self.by_parts:
            raw, cut = data.tobytes(), offs.tolist()
            ids = [[*g.ids, END] for g in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in zip(cut, cut[1:])], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self.hashes) > CACHE_PARTS:
            self.reset()
        raw = data.tobytes()
        if any(n in raw for n in self.names):
            page = tx.Page(data, offs, tx.INKED)
        else:
            raw, page = raw.lower(), Parts(data, offs, tx.INKED, lower=True)  # bytes.lower() changes A-Z alone
        uniq, where, back = np.unique(page.words, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, uniq)
        seen = spot < len(self.hashes)
        seen[seen] = self.hashes[spot[seen]] == uniq[seen]
        known = np.zeros(len(uniq), np.int64)
        known[seen] = self.slots[spot[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            start, end = page.spans
            got = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist())], add_special_tokens=False)
            ids = [g.ids for g in got]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            known[new] = len(self.size) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            self.hashes, self.slots = np.insert(self.hashes, spot[new], uniq[new]), np.insert(self.slots, spot[new], known[new])
        slots = np.insert(known[back], page.first[1:], 0)
        sizes = self.size[slots]
        upto = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[slots] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        ends = upto[page.first[1:] + np.arange(page.n)]
        return ids, np.diff(np.concatenate([[0], ends]))


_READY: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder; a worker that serves several tasks keeps what it has encoded."""
    key = hash(tokenizer_json)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(tokenizer_json)
    return _READY[key]


def write(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encode ``docs`` into files under ``folder``; returns the manifest: part, file, documents, tokens, base.

    ``base`` is the number of ids in all files before this one.  Without a
    folder, a fresh one under ``spark.checkpoint.dir`` is taken.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, f"tokens/{uuid.uuid4().hex[:12]}")
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, out, own = TaskContext.get().partitionId(), None, None, encoder(sent.value)
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(1), PIECE):
                if out is None:
                    store, root = filesystem(folder)
                    store.create_dir(root, recursive=True)
                    name = f"{root}/part-{part:06d}-{uuid.uuid4().hex[:8]}.ids.zst"
                    sink = store.open_output_stream(name + ".tmp")
                    out = tokenfile.Writer(sink, "<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
                ids, sizes = own.encode(data, offs)
                at = 0
                for key, n in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), sizes.tolist()):
                    out.add(key, ids[at : at + n])
                    at += n
        if out is not None:
            out.close()
            sink.close()
            store.move(name + ".tmp", name)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(out.ids)]), pa.array([out.tokens])],
                                             names=["part", "file", "documents", "tokens"])

    turn = ["doc_id", F.xxhash64("text")]  # an id that many rows share goes to several tasks and files
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*turn).sortWithinPartitions(*turn)
    done = stage(ordered.mapInArrow(run, "part long, file string, documents long, tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return done.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian 32-bit) of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                folder, name = file.rsplit("/", 1)
                store, root = filesystem(folder)
                with store.open_input_file(f"{root}/{name}") as source:
                    rows, size = [], 0
                    for key, start, ids in tokenfile.Reader(source).documents():
                        rows.append((key, base + start, ids.astype("<u4").tobytes()))
                        size += 4 * len(ids)
                        if size >= 4 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"])

    files = max(1, min(manifest.count(), 10_000))  # tasks, not a limit on files
    return manifest.select("file", "base").repartition(files, "file").mapInArrow(run, "doc_id long, start long, ids binary")
