"""Operator 4: personal data by a skip-chain conditional random field.

A document's mentions are the matches of the four base patterns and, in the gaps
between them, everything that looks remotely like one (an ``@`` word, seven
digits or more, a dotted quad).  Mentions form a chain in reading order; distant
mentions that repeat or resemble one another (the same last seven digits, the
same mail name) share a further potential.  Labels are O and the four kinds.
Base matches are observed; loopy message passing infers the others, so that a
mention which by itself would not pass is labelled like its twin elsewhere in
the document.  Text without a mention has no free node and needs no inference.

The potentials are learned here: a multinomial logistic unary over shape and
context features and the chain's transitions, from the mentions of a bounded
sample of documents (``SAMPLE``, the first by a hash of doc_id; the unary from the
first ``MENTIONS`` mentions of theirs), with the base patterns as labels; the shared potential is the log odds that two linked base
mentions have one kind.

Cases: a null text counts as empty; an empty text has no spans and the digest of
the empty string; repeated rows are read each; an empty sample leaves a model
that adds nothing; other columns aren't read (except by ``redact``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a match never begins inside a run of digits: the one from the run's start would come first
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
LOOSE = re.compile(r"""[^\s@<>()\[\],;:"']+""")
LOOSE_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
LABELS = 1 + len(KINDS)  # 0 is O
FEATURES = 256
SAMPLE = 2000
ROUNDS = 20
#: mentions whose features the unary potentials are fitted on, of the sample's: a bound of the fit
MENTIONS = 20_000
#: prior log odds that mentions with one key are one kind; base labels alone can't
#: show it, since a twin that fails the patterns counts as O among them
TWIN = 6.0
DAMPING = 0.5


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def quad(text: str) -> bool:
    parts = [x.lstrip("0") or "0" for x in text.split(".")]
    return len(parts) == 4 and all(len(x) <= 3 and x.isascii() and x.isdigit() and int(x) <= 255 for x in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of local+@domain, found from the @ signs outwards."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and LOCAL.match(text, lo - 1, lo):
            lo -= 1
        m = DOMAIN.match(text, at)
        if m and lo < at:
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def loose_mails(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of LOOSE characters on both sides of an @ in text[at:end], leftmost and
    non-overlapping, found from the @ signs outwards: each character is looked at twice at most."""
    sign = text.find("@", at, end)
    while sign >= 0:
        lo = sign
        while lo > at and LOOSE.match(text, lo - 1, lo):
            lo -= 1
        m = LOOSE.match(text, sign + 1, end)
        if m and lo < sign:
            yield lo, m.end()
            at = m.end()
        else:
            at = sign + 1
        sign = text.find("@", at, end)


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind number, end)."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if quad(m[0])]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) in reading order; label 0: not a base match."""
    out, at = [], 0
    has_mail, has_digit = "@" in text, DIGIT.search(text) is not None
    if not base and not has_mail and not has_digit:
        return []
    for a, kind, b in [*base, (len(text), -1, len(text))]:
        if a > at:
            if has_mail:
                out += [(x, y, 0) for x, y in loose_mails(text, at, a)]
            if has_digit:
                for m in LOOSE_NUMBER.finditer(text, at, a):
                    n = len(NOT_DIGIT.sub("", m[0]))
                    if n >= 7 or n >= 4 and IP.fullmatch(m[0]):
                        out.append((*m.span(), 0))
        if kind >= 0 and a >= at:
            out.append((a, b, kind + 1))
        at = max(at, b)
    out.sort()
    return out


def link_key(piece: str) -> str:
    """Mentions with one key resemble one another."""
    if "@" in piece:
        return "@" + piece.split("@")[0].lower()
    digits = NOT_DIGIT.sub("", piece)
    return piece if len(digits) < 7 else digits[-7:]


def features(text: str, a: int, b: int) -> list[int]:
    piece = text[a:b]
    digits = NOT_DIGIT.sub("", piece)
    before = text[max(0, a - 24):a].rstrip(" +(").rsplit(" ", 1)[-1].lower()
    names = [f"digits{min(len(digits), 24)}", f"mail{'@' in piece}", f"host{piece.count('.', piece.find('@') + 1) if '@' in piece else -1}",
             *(f"has{c}" for c in " -.()" if c in piece), f"groups{min(9, len(re.findall('[0-9]+', piece)))}",
             f"luhn{14 <= len(digits) <= 19 and luhn(digits)}", f"quad{quad(piece)}", f"before{before[-8:]}",
             f"letters{min(9, sum(map(str.isalpha, piece)))}"]
    return [crc32(x.encode()) % (FEATURES - 1) for x in names] + [FEATURES - 1]


class Field:
    """unary: (features, labels); chain: (label, next label); share: the
    potential of a linked pair with one kind (its negative for two kinds)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, share: float):
        self.unary, self.chain = unary, chain
        self.skip = np.zeros((LABELS, LABELS))
        self.skip[1:, 1:] = -share
        np.fill_diagonal(self.skip[1:, 1:], share)

    def added(self, text: str, nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans (start, kind number, end) of free mentions labelled as a kind."""
        if not any(label == 0 for _, _, label in nodes):
            return []
        local = np.zeros((len(nodes), LABELS))
        last: dict[str, int] = {}
        edges, kinds = [], []
        for i, (a, b, label) in enumerate(nodes):
            if label:
                local[i] = -30.0
                local[i, label] = 0.0
            else:
                local[i] = self.unary[features(text, a, b)].sum(axis=0)
            if i:
                edges.append((i - 1, i))
                kinds.append(0)
            key = link_key(text[a:b])
            if key in last:  # repeats are linked to the one before: a chain of twins
                edges.append((last[key], i))
                kinds.append(1)
            last[key] = i
        best = self.marginals(local, np.array(edges, dtype=int).reshape(-1, 2), np.array(kinds, dtype=int))
        label = best.argmax(axis=1)
        return [(a, int(label[i]) - 1, b) for i, (a, b, own) in enumerate(nodes)
                if own == 0 and label[i] and best[i, label[i]] >= 0.5]

    def marginals(self, local: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Loopy sum-product in log space, damped, all messages at once."""
        normal = lambda x: x - np.logaddexp.reduce(x, axis=-1, keepdims=True)
        if len(edges):
            pair = np.stack([self.chain, self.skip])[kinds]  # (edges, from label, to label)
            ahead = np.zeros((len(edges), LABELS))  # message to edges[:, 1]
            back = np.zeros((len(edges), LABELS))
            for _ in range(ROUNDS):
                total = local.copy()
                np.add.at(total, edges[:, 1], ahead)
                np.add.at(total, edges[:, 0], back)
                new_ahead = normal(np.logaddexp.reduce((total[edges[:, 0]] - back)[:, :, None] + pair, axis=1))
                new_back = normal(np.logaddexp.reduce((total[edges[:, 1]] - ahead)[:, None, :] + pair, axis=2))
                change = max(np.abs(new_ahead - ahead).max(), np.abs(new_back - back).max())
                ahead += DAMPING * (new_ahead - ahead)
                back += DAMPING * (new_back - back)
                if change < 1e-4:
                    break
            local = local.copy()
            np.add.at(local, edges[:, 1], ahead)
            np.add.at(local, edges[:, 0], back)
        return np.exp(normal(local))


def learn(texts: list[str], most: int = MENTIONS) -> Field:
    """Potentials from the mentions of some texts."""
    rows, labels = [], []
    moves = np.ones((LABELS, LABELS))
    same, other = 1.0, 1.0
    for text in texts:
        nodes = mentions(text, scan(text))
        last: dict[str, int] = {}
        for i, (a, b, label) in enumerate(nodes):
            if len(rows) < most:
                rows.append(features(text, a, b))
                labels.append(label)
            if i:
                moves[nodes[i - 1][2], label] += 1
            key = link_key(text[a:b])
            if label and last.get(key):
                same, other = same + (last[key] == label), other + (last[key] != label)
            if label:
                last[key] = label
    if not rows:
        unary = np.zeros((FEATURES, LABELS))
        unary[-1, 0] = 10.0
        return Field(unary, np.zeros((LABELS, LABELS)), 0.0)
    x = np.zeros((len(rows), FEATURES))
    for i, r in enumerate(rows):
        np.add.at(x[i], r, 1.0)
    y = np.eye(LABELS)[labels]
    w = np.zeros((FEATURES, LABELS))
    rate = 1.0 / (0.5 * np.mean((x * x).sum(axis=1)))
    for _ in range(300):
        z = x @ w
        p = np.exp(z - np.logaddexp.reduce(z, axis=1)[:, None])
        w += rate * (x.T @ (y - p) / len(x) - 1e-3 * w)
    share = moves / moves.sum()
    chain = np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))
    # the unary already holds each label's frequency; transitions of rare labels are damped by the +1 counts
    return Field(w, np.clip(chain, -2, 2), float(np.log((same + 4) / other)) + TWIN)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learn from the first ``sample`` documents by a hash of doc_id; of rows that
    repeat an id the least text."""
    ids = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    return learn([r.text for r in rows])


def find(text: str, field: Field) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    base = scan(text)
    more = field.added(text, mentions(text, base))
    return base, sorted(set(base + more))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                base, spans = find(text.as_py() or "", field)
                counts = [0, 0, 0, 0]
                for _, kind, _ in base:
                    counts[kind] += 1
                out.append((*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans)))
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_map(src, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind in brackets; where spans overlap, the
    one that begins first names the whole stretch."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text`` (and
    n_chars brought up to date if there is such a column)."""
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            new = [None if t is None else redacted(t, find(t, field)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = arrow_map(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_documents(table(spark, sf_dir, "documents"))
