"""Operator 1: secrets in texts, also under nested encodings.

A worklist of layers per document starts with the text itself.  Every layer is
scanned; its URL escapes, Unicode escapes, base64 runs and compressed contents
are unwrapped into further layers until nothing new appears.  A layer that was
seen before at the same place of the document is not taken again, which ends
cycles (compressed data that inflates to itself among them).  Each layer keeps
a map from its characters to the document's code points, so that a match in any
layer is reported at the span of the document that it came from.

A base64 run may go on over line ends and may begin anywhere in a stretch of its
letters (after a path, say), so it is decoded at each of the four offsets.
Decoded bytes needn't be text as a whole: their readable stretches are scanned,
and compressed data is looked for at any place of them, all members of it.

The worklist ends without a bound on depth: URL, Unicode and base64 layers are
shorter than what they came from.  Inflated data is taken in windows of at most
``MAX_INFLATED`` bytes that overlap by ``OVERLAP``, one in memory at a time;
compressed data inside a window that ends before it does is read up to there
and counted in ``n_refused``.

Cases: a null text counts as empty; an empty text has no spans and the digest
of the empty string; repeated rows are scanned each; other columns aren't read.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

KINDS = ("assign", "access", "hex")
# ASCII flags: other characters that fold to these letters don't count
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# maximal runs: the greedy base pattern with its length test folded in
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: every assign match holds one of these, in either case
MENTION = re.compile(r"[:=]")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
MAX_INFLATED = 1 << 24
OVERLAP = 1 << 16
FED = 1 << 14  # compressed bytes inflated at once
#: no secret, plain or encoded, is in a shorter stretch
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of one layer."""
    out = []
    if MENTION.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text with the document's start and end position of each character
    (None: the document itself)."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The document's span of characters a..b (b exclusive, b > a)."""
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            at = np.arange(a, b, dtype=np.int64)
            return at, at + 1
        return self.start[a:b], self.end[a:b]


def as_text(data: bytes) -> str | None:
    """Decoded bytes as text if a stretch of them can be read; bytes that aren't
    UTF-8 as a whole stand for one character each."""
    if not READABLE.search(data):
        return None
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 6 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0


class Inflater:
    """The content of the gzip or zlib data at a place of some bytes, all members;
    ``end``: where reading stopped, ``whole``: at the end of a member."""

    def __init__(self, data: bytes, at: int):
        self.data, self.end, self.whole = data, at, False

    def pieces(self) -> Iterator[bytes]:
        view = memoryview(self.data)
        while is_packed(self.data[self.end:self.end + 8]):
            z, self.whole = zlib.decompressobj(47), False
            while not z.eof and self.end < len(view):
                fed = bytes(view[self.end:self.end + FED])
                before = z.copy()
                try:
                    out = z.decompress(fed, MAX_INFLATED)
                    while True:
                        if out:
                            yield out
                        if not z.unconsumed_tail:
                            break
                        out = z.decompress(z.unconsumed_tail, MAX_INFLATED)
                except zlib.error:  # what comes before the fault counts
                    try:
                        for i in range(len(fed)):
                            yield before.decompress(fed[i:i + 1])
                    except zlib.error:
                        return
                self.end += len(fed) - len(z.unused_data)
            if not z.eof:
                return
            self.whole = True

    def windows(self) -> Iterator[tuple[bytes, bool]]:
        """Content in windows, and whether more follows."""
        held = bytearray()
        for piece in self.pieces():
            held += piece
            while len(held) > MAX_INFLATED:
                yield bytes(held[:MAX_INFLATED]), True
                del held[:MAX_INFLATED - OVERLAP]
        if held:
            yield bytes(held), False


def constant(value: int, n: int) -> np.ndarray:
    return np.broadcast_to(np.int64(value), n)


def from_bytes(data: bytes, span: tuple[int, int], starts=None, ends=None, outer: frozenset = frozenset(), cut: bool = False) -> Iterator:
    """The layer of decoded bytes; an iterator like this one for each window of
    compressed data in them; 1 for compressed data that the window's end cuts.
    starts, ends: the document's position of each byte, when known."""
    mark = hashlib.sha256(data).digest()
    if mark in outer:
        return
    outer |= {mark}
    text = as_text(data)
    if text is not None:
        if starts is None:
            yield Layer(text, constant(span[0], len(text)), constant(span[1], len(text)))
        elif len(text) != len(data):  # characters of several bytes
            at = np.cumsum([0] + [len(c.encode()) for c in text])
            yield Layer(text, starts[at[:-1]], ends[at[1:] - 1])
        else:
            yield Layer(text, starts, ends)
    done = 0
    for at in [0] * is_packed(data) + [m.start() for m in PACKED.finditer(data)]:
        if at < done:
            continue
        inner = Inflater(data, at)
        own = span if starts is None else (int(starts[at:].min()), span[1])
        some = False
        for window, more in inner.windows():
            some = True
            yield from_bytes(window, own, outer=outer, cut=more)
        if inner.whole:
            done = inner.end
        elif cut and some and inner.end >= len(data):
            yield 1


def replaced(layer: Layer, pattern: re.Pattern, decode) -> tuple[Layer | None, list[tuple[bytes, int, int]]]:
    """The layer with every match decoded; a decoded character stands for the
    whole match.  Also the matches whose bytes aren't UTF-8: (bytes, from, to)."""
    text, parts, starts, ends, at, raw = layer.text, [], [], [], 0, []
    for m in pattern.finditer(text):
        new = decode(m[0])
        if isinstance(new, bytes):
            raw.append((new, *m.span()))
            new = new.decode("latin-1")  # its readable stretches, where they stand
        if new is None or new == m[0]:
            continue
        a, b = m.span()
        s, e = layer.spans(at, a)
        lo, hi = layer.span(a, b)
        parts += [text[at:a], new]
        step = (b - a) // max(len(new), 1)
        if layer.start is None and step * len(new) == b - a:  # escapes of one size each
            own = np.arange(len(new), dtype=np.int64) * step + a
            starts += [s, own]
            ends += [e, own + step]
        else:
            starts += [s, np.full(len(new), lo)]
            ends += [e, np.full(len(new), hi)]
        at = b
    if not parts:
        return None, raw
    s, e = layer.spans(at, len(text))
    return Layer("".join([*parts, text[at:]]), np.concatenate([*starts, s]), np.concatenate([*ends, e])), raw


def percent(run: str):
    data = bytes.fromhex(run.replace("%", ""))
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data


def escapes(run: str) -> str | None:
    try:
        if run.startswith("\\u"):
            return b"".join(bytes.fromhex(x) for x in run.split("\\u")[1:]).decode("utf-16-be")
        code = int(run[2:], 16) if run[0] == "\\" else int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return chr(code) if not 0xD800 <= code < 0xE000 else None
    except (ValueError, OverflowError, UnicodeDecodeError):
        return None


def base64_layers(layer: Layer) -> Iterator:
    for m in BASE64.finditer(layer.text):
        run = np.frombuffer(m[0].rstrip("=").translate({45: 43, 95: 47}).encode(), np.uint8)
        at = np.flatnonzero(run > 32)  # without line ends
        run = run[at].tobytes()
        s = e = None
        for skip in range(4):
            part = run[skip:]
            if len(part) % 4 == 1:
                part = part[:-1]
            data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
            if not (READABLE.search(data) or PACKED.search(data) or is_packed(data)):
                continue
            if s is None:
                s, e = layer.spans(*m.span())
                s, e = s[at], e[at]
            first = np.arange(len(data)) * 4 // 3 + skip
            last = np.minimum(first + 1, skip + len(part) - 1)
            yield from_bytes(data, (int(s[first].min()), int(e[last].max())), s[first], e[last])


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (start, kind number, end) and refused layers."""
    base = sorted(scan(text))
    if not ("%" in text or "\\" in text or "&#" in text or BASE64.search(text)):
        return base, base, 0
    found, refused, seen = set(base), 0, set()
    work = [iter([Layer(text)])]  # the next layers of each open layer, the last one first
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif isinstance(layer, int):
            refused += layer
        elif not isinstance(layer, Layer):
            work.append(layer)
        else:
            where = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(),
                     layer.span(0, len(layer.text)) if layer.text else None)
            if where in seen:
                continue
            seen.add(where)
            if layer.start is not None:
                for a, kind, b in scan(layer.text):
                    lo, hi = layer.span(a, b)
                    found.add((lo, kind, hi))
            work.append(unwrapped(layer))
    return base, widest(base, found), refused


def unwrapped(layer: Layer) -> Iterator:
    """The layers under one, and iterators of them."""
    for pattern, decode, mark in ((PERCENT, percent, "%"), (ESCAPE, escapes, None)):
        if mark is None and not ("\\" in layer.text or "&#" in layer.text) or mark and mark not in layer.text:
            continue
        new, raw = replaced(layer, pattern, decode)
        if new is not None:
            yield new
        for data, a, b in raw:
            yield from_bytes(data, layer.span(a, b))
    yield from base64_layers(layer)


def widest(base: list[tuple[int, int, int]], found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and of the others those that lie in no other span of their
    kind (a secret may show in several layers of one stretch)."""
    own, reach, out = set(base), [-1, -1, -1], []
    for a, kind, b in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        if (a, kind, b) in own or b > reach[kind]:
            out.append((a, kind, b))
        reach[kind] = max(reach[kind], b)
    return sorted(out)


def spans_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base), base_sha256, spans, n_refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                base, spans, refused = find_secrets(text.as_py() or "")
                counts = [0, 0, 0]
                for _, kind, _ in base:
                    counts[kind] += 1
                out.append((*counts, hashlib.sha256(spans_text(base, KINDS).encode()).hexdigest(),
                            spans_text(spans, KINDS), refused))
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_refused"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_map(src, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                               "spans string, n_refused long")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
