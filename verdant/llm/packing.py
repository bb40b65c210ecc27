"""Operator 8: hierarchical packing into context windows of several sizes.

Tiers are window sizes in tokens (512 ... 4096).  A document is routed to the
smallest tier that holds it; a longer one first fills windows of the largest
tier by itself and its rest is routed.  Each tier is packed largest document
first, every window taking the largest documents that still fit (best fit over
counts by length), and a window's gap is then filled from the shorter tiers,
longest fitting document first; a gap that no whole document fits is closed by
cutting one.  So windows are full, and a full window is a power of two: no padding.
What is left at the end of a partition (less than one window) is cut into
windows of powers of two.  Sequences are put into step groups of equal tokens.

A partition is packed as it streams, ``BUFFER_TOKENS`` at a time, so memory is
bounded by the buffer and the longest document, and nothing is shuffled.

Cases: a null or empty text is one end token; empty tables give no pieces;
repeated rows are packed once each; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder, piece_cache, pieces
from .common import arrow_map, slices, table

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
BUFFER_TOKENS = 1 << 21
#: words kept with their ids per worker: the library's model makes a missing one fast
CACHED = 200_000
#: tokens of one training step per group
STEP_TOKENS = 1 << 17
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


class Shelf:
    """Pieces of a tier by length: take the longest that fits."""

    def __init__(self):
        self.lengths: list[int] = []          # distinct lengths, ascending
        self.by: dict[int, list] = {}
        self.tokens = 0

    def add(self, piece) -> None:
        n = piece[2]
        if n not in self.by:
            bisect.insort(self.lengths, n)
            self.by[n] = []
        self.by[n].append(piece)
        self.tokens += n

    def take(self, most: int):
        """The longest piece of at most ``most`` tokens, or None."""
        at = bisect.bisect_right(self.lengths, most) - 1
        return None if at < 0 else self._pop(at)

    def cut(self, size: int):
        """``size`` tokens of the shortest piece longer than that; the rest stays."""
        at = bisect.bisect_right(self.lengths, size)
        if at == len(self.lengths):
            return None
        doc, start, n = self._pop(at)
        self.add((doc, start + size, n - size))
        return doc, start, size

    def _pop(self, at: int):
        n = self.lengths[at]
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[at]
        self.tokens -= n
        return piece


class Packer:
    """Pieces are (document number, start, length); windows are lists of them."""

    def __init__(self, tiers=TIERS):
        self.tiers = tuple(sorted(tiers))
        self.shelves = [Shelf() for _ in self.tiers]

    def route(self, doc: int, start: int, n: int) -> Iterator[list]:
        top = self.tiers[-1]
        while n > top:
            yield [(doc, start, top)]
            start, n = start + top, n - top
        if n:
            self._shelve((doc, start, n))

    def _shelve(self, piece) -> None:
        self.shelves[bisect.bisect_left(self.tiers, piece[2])].add(piece)

    def _fill(self, tier: int, size: int) -> list:
        """One window of ``size`` tokens from this tier, its gaps from shorter
        ones, the last gap by a cut."""
        window, left = [], size
        while left:
            piece = None
            for k in range(tier, -1, -1):
                piece = self.shelves[k].take(left)
                if piece:
                    break
            if piece is None:
                for k in range(tier + 1):
                    piece = self.shelves[k].cut(left)
                    if piece:
                        # what is left of a cut piece may belong to a shorter tier
                        break
            if piece is None:
                break
            window.append(piece)
            left -= piece[2]
        return window

    def windows(self, last: bool) -> Iterator[list]:
        """Full windows, the largest tier first; at the end also the rest, in
        windows of powers of two."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.shelves[tier].tokens and sum(s.tokens for s in self.shelves[:tier + 1]) >= size:
                yield self._fill(tier, size)
        if last:
            top = len(self.tiers) - 1
            while rest := sum(s.tokens for s in self.shelves):
                yield self._fill(top, min(1 << (rest.bit_length() - 1), self.tiers[-1]))


def word_bytes(path: str):
    """The ids of a word as bytes, by the library's own model; it is read with the
    first word, as a task that finds the worker's cache needs no model of its own."""
    enc, model = encoder(path), []

    def by_library(symbols: str) -> list[int]:
        if not model:
            from tokenizers import Tokenizer
            model.append(Tokenizer.from_file(path).model)
        return [t.id for t in model[0].tokenize(symbols)]

    return lambda word: array("I", enc.ids(word, by_library)).tobytes()


def pack_documents(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS,
                   buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (window size), step_group."""
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_cache(where, "bytes", word_bytes(where), b"".join, CACHED)
        part = TaskContext.get().partitionId() << 40
        packer, held, number, sequences = Packer(tiers), {}, 0, 0
        filled: dict[int, int] = {}

        def emit(windows) -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            rows = []
            for window in windows:
                total = sum(p[2] for p in window)
                step = filled.get(total, 0) // step_tokens
                filled[total] = filled.get(total, 0) + total
                offset = 0
                for doc, start, n in window:
                    doc_id, ids = held[doc][:2]
                    rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start:4 * (start + n)]), len(ids) // 4,
                                 part + sequences, offset, total, part + (total << 24) + step))
                    offset += n
                    held[doc][2] -= n
                    if not held[doc][2]:
                        del held[doc]
                sequences += 1
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 50_000]), types)], names=names)

        waiting = 0
        own: list[list] = []
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = b"".join([x for p in pieces(text.as_py() or "") for x in known.values(p)])
                ids += array("I", [END_ID]).tobytes()
                n = len(ids) // 4
                held[number] = [doc_id, ids, n]
                own.extend(packer.route(number, 0, n))
                number += 1
                waiting += n
                if waiting >= buffer_tokens:
                    yield from emit([*own, *packer.windows(False)])
                    own, waiting = [], sum(s.tokens for s in packer.shelves)
        yield from emit([*own, *packer.windows(True)])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_map(src, run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
