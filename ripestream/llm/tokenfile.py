"""Token ids in independent zstandard frames with a trailing seek table.

Layout of a file (all numbers little-endian):

* data frames: each a zstandard frame of the ids of one or more whole documents;
* one skippable frame with the document index (compressed): a JSON header,
  then ids, null flags and token counts of the documents;
* the seek table: a skippable frame with one entry per data frame (compressed
  size, content size, checksum) and a footer, as in zstandard's public seekable
  format, so its tools can read the data.  The checksum is the low half of
  XXH64 of the content.

A reader loads the seek table and the index, then decompresses only the frames
that hold the requested documents, checking each.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

#: Fixed values of the public seekable format.
SEEK_MAGIC, FRAME_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
FRAME_BYTES = 1 << 18


class CorruptFrame(ValueError):
    """A frame or index that doesn't match its checksum or size."""


def _sum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Streams documents into ``sink``; memory holds one frame and the index."""

    def __init__(self, sink, dtype: str = "<u2", frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.sink, self.dtype, self.limit = sink, np.dtype(dtype), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.size = self.tokens = 0
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        data = tokens.astype(self.dtype).tobytes()
        self.held.append(data)
        self.size += len(data)
        self.tokens += len(tokens)
        self.ids.append(doc_id)
        self.counts.append(len(tokens))
        if self.size >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.size:
            data = b"".join(self.held)
            packed = self.packer.compress(data)
            self.sink.write(packed)
            self.entries.append((len(packed), len(data), _sum(data)))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        head = json.dumps({"dtype": self.dtype.str, "documents": len(self.ids), "tokens": self.tokens}).encode()
        nulls = np.array([x is None for x in self.ids], np.uint8)
        ids = np.array([0 if x is None else x for x in self.ids], "<i8")
        body = struct.pack("<I", len(head)) + head + ids.tobytes() + nulls.tobytes() + np.array(self.counts, "<u4").tobytes()
        packed = self.packer.compress(body)
        self.sink.write(struct.pack("<III", INDEX_MAGIC, len(packed) + 4, _sum(body)) + packed)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self.sink.write(struct.pack("<II", FRAME_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC))


class Reader:
    """Random access to the documents of one file; ``source`` has ``read``, ``seek`` and ``size()``."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise CorruptFrame("no seek table with checksums")
        table = self._at(end - 9 - 12 * frames, 12 * frames)
        self.entries = np.frombuffer(table, "<u4").reshape(frames, 3).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.content = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        at = int(self.begins[-1])
        magic, size, total = struct.unpack("<III", self._at(at, 12))
        unpack = zstandard.ZstdDecompressor()
        body = unpack.decompress(self._at(at + 12, size - 4))
        if magic != INDEX_MAGIC or _sum(body) != total:
            raise CorruptFrame("the document index doesn't match its checksum")
        n = struct.unpack("<I", body[:4])[0]
        head = json.loads(body[4 : 4 + n])
        docs, at = head["documents"], 4 + n
        self.dtype, self.unpack = np.dtype(head["dtype"]), unpack
        ids, nulls = np.frombuffer(body, "<i8", docs, at), np.frombuffer(body, np.uint8, docs, at + 8 * docs)
        self.counts = np.frombuffer(body, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.ids = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.decompressed = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, begin: int, size: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            packed, size, total = self.entries[k]
            try:
                data = self.unpack.decompress(self._at(int(self.begins[k]), int(packed)), max_output_size=int(size))
            except zstandard.ZstdError as e:
                raise CorruptFrame(f"frame {k}: {e}") from e
            if len(data) != size or _sum(data) != total:
                raise CorruptFrame(f"frame {k} doesn't match its checksum")
            self.decompressed += 1
            self._last = (k, data)
        return self._last[1]

    def documents(self, numbers: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, tokens before it in the file, token ids) of the documents with these positions, or of all."""
        width = self.dtype.itemsize
        for i in range(len(self.counts)) if numbers is None else numbers:
            lo, n = int(self.starts[i]) * width, int(self.counts[i])
            if n:
                k = int(np.searchsorted(self.content, lo, side="right")) - 1
                tokens = np.frombuffer(self.frame(k), self.dtype, n, lo - int(self.content[k]))
            else:
                tokens = np.zeros(0, self.dtype)
            yield self.ids[i], int(self.starts[i]), tokens
