"""Operator 3: BPE encoding as a bounded-lookahead transducer, and decoding.

Encoding.  A merge list is *proper* when every part of a rule is a base symbol
or made by an earlier rule.  For a proper list a token sequence is the BPE
encoding of a word exactly when every two neighbours stay apart, and whether
two tokens stay apart depends on these two alone: replay both derivations in
rule order and look for a rule (a, b) whose a is still the right edge of the
left token and whose b is still the left edge of the right one (``Merges.apart``).
So every prefix of a word has one last token, found from at most ``lookahead``
(the longest token, in symbols) earlier prefixes.  Any later prefix ends its
known part within the last ``lookahead`` positions; what the chains of these
positions have in common can't change any more and is emitted.  Memory is the
window plus the chains that still differ, not the word.

Decoding is a state machine from ids to text: the library's form (token strings
joined by a space, as its ``decode`` without a decoder gives) and the byte form,
which keeps the bytes of an unfinished character between tokens.

Cases: null text is empty; an empty text has no tokens, both digests are of
the empty string; special tokens' strings in a text become their ids, as in
the library; a lone surrogate can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
MARK = "\x00"  # the end mark as one symbol; no byte has this symbol
#: Words kept with their encoding per worker, and the longest word kept.
CACHE_WORDS = 400_000
CACHE_LENGTH = 64
#: Texts are taken in pieces of about so many characters, cut at a space.
PIECE = 1 << 20


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """One printable character per byte: Latin-1's printable ones stand for
    themselves, the others for the characters from U+0100 on, in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Merges:
    """The rule tables of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        size = {s: 1 for b in byte_symbols().values() for s in (b, b + END)}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if a not in size or b not in size or a + b in self.parts:
                raise ValueError(f"the merge list is not proper at rule {r}")
            self.rank[a, b], self.parts[a + b], size[a + b] = r, (a, b, r), size[a] + size[b]
        #: sufficient lookahead in symbols: the longest token
        self.lookahead = max(size.values())
        #: all tokens, found as they end by one pass over the symbols; the end
        #: mark is one symbol of its own here
        self.size: dict[int, int] = {}
        self.find = ahocorasick.Automaton()
        for t, i in self.ids.items():
            form = t.removesuffix(END) + MARK if t.endswith(END) else t
            self.size[i] = len(form)
            self.find.add_word(form, (len(form), i))
        self.find.make_automaton()
        self.token = {i: t for t, i in self.ids.items()}
        self._left: dict[str, list] = {}
        self._right: dict[str, list] = {}
        self._apart: dict[int, bool] = {}

    def _edge(self, token: str, side: int, memo: dict) -> list[tuple[str, float]]:
        """Edge symbols of a token's derivation with the rule that consumes each."""
        if token not in memo:
            out, t, until = [], token, float("inf")
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.parts[t][2], self.parts[t][side]
            memo[token] = out
        return memo[token]

    def apart(self, a: str, b: str) -> bool:
        """Whether neighbours a, b stay two tokens.  On equal rules the left
        one applies first: an a consumed by the same rule wins over the
        boundary, a b consumed by it loses to the boundary."""
        rank, left = self.rank, self._edge(b, 0, self._left)
        for x, x_until in self._edge(a, 1, self._right):
            for y, y_until in left:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _decide(self, key: int) -> bool:
        if len(self._apart) > 1_000_000:
            self._apart.clear()
        known = self._apart[key] = self.apart(self.token[key >> 20], self.token[key & 0xFFFFF])
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (of symbols), as the transducer emits them.  A word
        within its window is one step of it, without state to carry."""
        look = 64 * self.lookahead
        if len(word) < 4 * self.lookahead:
            return self._within(word + MARK)
        t = Transducer(self)
        out = [i for at in range(0, len(word), look) for i in t.feed(word[at:at + look])]
        return out + t.finish()


    def _within(self, symbols: str) -> list[int]:
        last, decided, size_of = [-1] * (len(symbols) + 1), self._apart, self.size
        for end, (size, i) in self.find.iter(symbols):
            end += 1
            if last[end] < 0:
                if size == end:
                    last[end] = i
                    continue
                left = last[end - size]
                if left >= 0:
                    known = decided.get(left << 20 | i)
                    if known or known is None and self._decide(left << 20 | i):
                        last[end] = i
        out, at = [], len(symbols)
        while at:
            i = last[at]
            out.append(i)
            at -= size_of[i]
        return out[::-1]


class Transducer:
    """Streams the symbols of one word to token ids; ``finish`` adds the end mark."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.found = merges.find.iter("")
        self.base = 0     # tokens that end up to here were emitted
        self.last = [-1]  # last token of every prefix from base on; its left neighbour at base

    def _advance(self, symbols: str) -> None:
        last, base, decided, decide = self.last, self.base, self.m._apart, self.m._decide
        last.extend([-1] * len(symbols))
        self.found.set(symbols, False)
        for end, (size, i) in self.found:
            at = end + 1 - base
            if last[at] < 0:
                left = last[at - size] if at >= size else None
                if left is None:
                    continue
                if at - size + base == 0:
                    last[at] = i
                elif left >= 0:
                    key = left << 20 | i
                    known = decided.get(key)
                    if known or known is None and decide(key):
                        last[at] = i

    def feed(self, symbols: str) -> list[int]:
        self._advance(symbols)
        return self._emit() if len(self.last) > 4 * self.m.lookahead else []

    def finish(self) -> list[int]:
        self._advance(MARK)
        return self._chain(len(self.last) - 1)

    def _chain(self, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(self.last[at])
            at -= self.m.size[out[-1]]
        return out[::-1]

    def _emit(self) -> list[int]:
        """Emit what the chains of the last ``lookahead`` positions share."""
        n = len(self.last) - 1
        shared = self._chain(n)
        for at in range(n - self.m.lookahead + 1, n):
            k = 0
            for x, y in zip(shared, self._chain(at)):
                if x != y:
                    break
                k += 1
            del shared[k:]
        step = sum(self.m.size[i] for i in shared)
        self.base += step
        del self.last[:step]
        return shared


def word_pattern(top: int) -> re.Pattern:
    """Contractions, letter runs, single numbers and runs of other characters,
    with the classes written out for the characters below ``top``."""
    letters, numbers = (_ranges(k, top) for k in "LN")
    return re.compile(rf"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{letters}{numbers}]+")


#: The characters of Unicode's White_Space property.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(kind: str, top: int) -> str:
    """The characters of a Unicode class as the library's own Unicode version
    has them: it is asked once for the runs of that class over all characters."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    every = [chr(c) for c in range(top) if not 0xD800 <= c < 0xE000]
    runs = Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str("".join(every))
    return "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x, _ in runs)


#: Characters below this one take the short pattern.
NEAR = 0x530
FAR = re.compile(f"[^\x00-{chr(NEAR - 1)}]")


def lowered(text: str) -> str:
    """Lower case of every character by itself (no final sigma)."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces that end before a space or line end (words don't
    reach across them), so that long texts need bounded memory."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut <= at:
            more = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            if not more:
                break
            cut = min(more)
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """Text to words to tokens, with a bounded memory of words seen."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special: dict[str, int] = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        from tokenizers.normalizers import NFC, Lowercase, Sequence
        self.chunk = re.compile(f"[^{SPACES}]+").findall
        self.near, self.far = word_pattern(NEAR).findall, None
        self.normal = Sequence([NFC(), Lowercase()]).normalize_str
        self.table = str.maketrans({chr(b): s for b, s in byte_symbols().items()})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.marks = tuple({s[:2] for s in self.special})

    @cached_property
    def merges(self) -> Merges:
        """The rule tables, some 45 MB: made when a word is first encoded by them."""
        return Merges(self.path)

    def words(self, text: str) -> list[str]:
        """Words of a piece; special tokens stand as they are (they hold upper
        case or <|...|> and so are told apart by the caller's look-up)."""
        if any(x in text for x in self.marks):
            out: list[str] = []
            for i, part in enumerate(self.split(text)):
                out += ["\0" + part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.near(text.lower())
        if not FAR.search(text):
            text = lowered(unicodedata.normalize("NFC", text))
            if not FAR.search(text):
                return self.near(text)
        self.far = self.far or word_pattern(0x110000).findall
        return self.far(self.normal(text))

    def chunks(self, text: str) -> list[str] | None:
        """The stretches between white space, which words don't reach across; None
        if the piece may hold special tokens, which do."""
        return None if any(x in text for x in self.marks) else self.chunk(text)

    def symbols(self, word: str) -> str:
        return word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.table)

    def ids(self, word: str, encode=None) -> list[int]:
        """Ids of a word by the merges here, or by another encoder of symbols."""
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        return (encode or self.merges.encode_word)(self.symbols(word))


class Decoder:
    """Ids to text, a token at a time."""

    def __init__(self, merges: Merges):
        self.token = {i: t for t, i in (merges.ids | merges.special).items()}
        self.special = set(merges.special.values())
        self.byte = {s: b for b, s in byte_symbols().items()}
        self.state = b""

    def joined(self, ids) -> str:
        """The library's form: token strings joined by a space."""
        return " ".join(map(self.token.__getitem__, ids))

    def feed(self, token_id: int) -> str:
        """The text that this token completes; an end mark closes a word with a
        space, bytes of an unfinished character wait in ``state``."""
        t = self.token[token_id]
        if token_id in self.special:
            return self._flush() + t + " "
        ends = t.endswith(END)
        data = self.state + bytes(self.byte[c] for c in t.removesuffix(END))
        if ends:
            self.state = b""
            return data.decode("utf-8", "replace") + " "
        keep = self._unfinished(data)
        self.state = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't whole yet."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if need > back else 0
            if b < 0x80:
                return 0
        return 0

    def _flush(self) -> str:
        data, self.state = self.state, b""
        return data.decode("utf-8", "replace")

    def text(self, ids) -> str:
        out = "".join(map(self.feed, ids)) + self._flush()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class WordCache(dict):
    """word -> value of its encoding; missing words are encoded, long words are
    not kept, and a full cache starts anew."""

    def __init__(self, make, most: int = CACHE_WORDS):
        self.make, self.most = make, most

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class PieceCache:
    """Values of a piece's words, looked up by white-space chunk: a chunk (a word
    with its punctuation, as written) stands for its normalised words' values,
    put together by ``join``.  An ASCII word is a chunk that stands for itself, so it
    is kept once; ``words`` has the others."""

    def __init__(self, enc: Encoder, make, join, most: int = CACHE_WORDS):
        self.enc = enc
        near, plain = enc.near, enc._plain

        def together(chunk: str):
            found = near(chunk.lower()) if chunk.isascii() else plain(chunk)
            if len(found) != 1:
                return join([self.word(w) for w in found])
            return make(chunk) if found[0] == chunk and chunk.isascii() else self.word(found[0])

        self.words, self.known = WordCache(make, most), WordCache(together, most)

    def word(self, word: str):
        return (self.known if word.isascii() and word[0] != "\0" else self.words)[word]

    def values(self, piece: str) -> list:
        chunks = self.enc.chunks(piece)
        if chunks is None:
            return [self.word(w) for w in self.enc.words(piece)]
        return list(map(self.known.__getitem__, chunks))


_CACHES: dict[tuple[str, str], PieceCache] = {}


def piece_cache(path: str, kind: str, make, join, most: int = CACHE_WORDS) -> PieceCache:
    """The cache of one kind of values, kept by the worker process from task to task."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = PieceCache(encoder(path), make, join, most)
    return _CACHES[path, kind]


def forget() -> None:
    """Lets go of what this worker process keeps for encoding; called by the steps
    that may come after it in the same process."""
    _CACHES.clear()
    _ENCODERS.clear()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document."""
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        dec = Decoder(enc.merges)

        def make(word: str) -> tuple[str, str]:
            ids = enc.ids(word)
            return " ".join(map(str, ids)), dec.joined(ids)

        known = piece_cache(where, "texts", make, lambda each: tuple(map(" ".join, zip(*each))))
        for b in batches:
            out = []
            for text in b.column(1):
                n, ids_hash, text_hash, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
                for piece in pieces(text.as_py() or ""):
                    found = known.values(piece)
                    if found:
                        ids, decoded = map(" ".join, zip(*found))
                        n += ids.count(" ") + 1
                        ids_hash.update((gap + ids).encode())
                        text_hash.update((gap + decoded).encode())
                        gap = " "
                out.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                              pa.array(cols[2], pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_map(src, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
