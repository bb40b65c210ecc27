"""Operator 6: toxicity by a bidirectional gated recurrent network.

Words are read in overlapping windows of ``WINDOW`` words every ``STRIDE``.  A
word's input joins a word vector (hashed vocabulary) with a character vector
(the mean of its hashed character pairs).  A GRU reads each window both ways,
attention pools its states, a logistic unit scores it; a document's score is
that of its worst window, so every word of every text is scored.

Training is done here, in numpy, on a bounded sample of labelled documents
(``SAMPLE`` per class, the first by a hash of doc_id) with Adam, on random
windows at first and then on the documents' highest ones.  Scoring runs in Arrow batches on all executors;
the model (a few MB) travels with the function.

Cases: a null or empty text has one empty window (a constant score); very long
texts are scored in slices of windows; without labelled rows of both classes the
score is the share of label 1 among them (0 without labels); a document labelled
more than once counts as toxic if any label says so; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc_bucket, table

WINDOW, STRIDE = 32, 24
WORDS, CHARS = 1 << 20, 1 << 12  # hash spaces
#: words in fewer training documents share one vector
MIN_DOCS = 3
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 10, 6, 6, 4
SAMPLE = 1000
STEPS, BATCH = 500, 32
#: share of the steps on random windows, before the highest ones are taken
RANDOM = 0.4
#: words that say nothing fall back to zero
DROP = 0.15  # share of words hidden in training
DECAYED, DECAY = ("word", "char"), 0.3
SLICE = 512  # windows scored at once: their states fit a core's cache
SEED = 7


class Words:
    """Rows of the input tables for the words of a text, without a Python step
    per word: bytes to classes, classes to word numbers by a rolling hash."""

    #: lower-cased bytes; anything but letters, digits and bytes above 127 ends a word
    FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
    INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in FOLD])
    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    @classmethod
    def read(cls, text: str):
        """(word buckets, pair buckets of all bytes inside words, pairs' word starts)."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        low, inside = cls.FOLD[raw], cls.INSIDE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        code = low[inside].astype(np.uint64) + np.uint64(1)
        size = end - start
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = (np.arange(len(code)) - np.repeat(at, size)).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (code + place * cls.BASE) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            word = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), at)
            word ^= word >> np.uint64(31)
            before = np.concatenate([[np.uint64(0)], code[:-1]])
            before[at] = 0
            pair = (before * np.uint64(257) + code) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 12)
        return (word % np.uint64(WORDS)).astype(np.int64), pair.astype(np.int64), at


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """The network's arrays; inputs are rows (word, mean of character pairs)."""

    def __init__(self, index: np.ndarray, seed: int = SEED):
        #: word hash -> row of the word vectors; 0: too rare to have its own
        self.index = index
        words = int(index.max()) + 1
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.01 * rng.standard_normal((words, WORD_DIM)).astype(np.float32),
                  "char": 0.1 * mat(CHARS, CHAR_DIM),
                  # both directions side by side: (direction, in, 3 gates x hidden)
                  "W": np.stack([mat(d, 3 * h), mat(d, 3 * h)]), "U": np.stack([mat(h, 3 * h), mat(h, 3 * h)]),
                  "b": np.zeros((2, 3 * h), np.float32), "A": mat(2 * h, ATTENTION), "a": mat(ATTENTION, 1)[:, 0],
                  "o": mat(2 * h, 1)[:, 0], "c": np.full(1, -1.0, np.float32)}

    def inputs(self, text: str) -> np.ndarray:
        """(words, word + character vector) of a text."""
        word, pair, at = Words.read(text)
        if not len(word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        n = np.diff(np.append(at, len(pair)))[:, None]
        return np.concatenate([self.p["word"][self.index[word]], np.add.reduceat(self.p["char"][pair], at) / n], axis=1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows x (n, T, d); mask (n, T) marks words."""
        p, h = self.p, HIDDEN
        n, steps, _ = x.shape
        states = np.zeros((2, steps, n, h), np.float32)
        kept = []
        for way in (0, 1):
            gates_in = (x.reshape(n * steps, -1) @ p["W"][way] + p["b"][way]).reshape(n, steps, 3 * h)
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                g = gates_in[:, t]
                u = s @ p["U"][way][:, :2 * h]
                zr = sigmoid(g[:, :2 * h] + u)
                z, r = zr[:, :h], zr[:, h:]
                rs = r * s
                cand = np.tanh(g[:, 2 * h:] + rs @ p["U"][way][:, 2 * h:])
                m = mask[:, t, None]
                new = s + m * z * (cand - s)
                if keep:
                    kept.append((way, t, s, z, r, cand, rs))
                states[way, t] = s = new
        both = np.concatenate([states[0], states[1]], axis=2)  # T, n, 2h
        hidden = np.tanh(both @ p["A"])
        e = hidden @ p["a"]
        e = np.where(mask.T > 0, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w = w * mask.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * both).sum(axis=0)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (both, hidden, w, pooled, kept)) if keep else logit

    def backward(self, x, mask, dlogit, saved) -> tuple[dict, np.ndarray]:
        p, h = self.p, HIDDEN
        both, hidden, w, pooled, kept = saved
        n, steps, d = x.shape
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        g["o"], g["c"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["o"]
        dboth = w[:, :, None] * dpool
        dw = (both * dpool).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["a"] = np.tensordot(de, hidden, axes=([0, 1], [0, 1]))
        dh = de[:, :, None] * p["a"] * (1 - hidden ** 2)
        g["A"] = both.reshape(-1, 2 * h).T @ dh.reshape(-1, ATTENTION)
        dboth = dboth + dh @ p["A"].T
        dx = np.zeros_like(x)
        ds = {0: np.zeros((n, h), np.float32), 1: np.zeros((n, h), np.float32)}
        for way, t, s, z, r, cand, rs in reversed(kept):
            U, m = p["U"][way], mask[:, t, None]
            dn = ds[way] + dboth[t][:, way * h:(way + 1) * h]
            dz = dn * m * (cand - s) * z * (1 - z)
            dc = dn * m * z * (1 - cand ** 2)
            drs = dc @ U[:, 2 * h:].T
            dr = drs * s * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            ds[way] = dn * (1 - m * z) + drs * r + dzr @ U[:, :2 * h].T
            dg = np.concatenate([dzr, dc], axis=1)
            g["U"][way][:, :2 * h] += s.T @ dzr
            g["U"][way][:, 2 * h:] += rs.T @ dc
            g["W"][way] += x[:, t].T @ dg
            g["b"][way] += dg.sum(axis=0)
            dx[:, t] += dg @ p["W"][way].T
        return g, dx

    def fused(self) -> tuple:
        """The arrays of ``logits``: both directions as one block-diagonal
        network, features in rows, the sigmoid's inner half folded in."""
        p, h = self.p, HIDDEN
        order = [way * 3 * h + gate * h + i for gate in range(3) for way in (0, 1) for i in range(h)]
        scale = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), 2 * h)
        W = np.concatenate(list(p["W"]), axis=1)[:, order] * scale
        b = np.concatenate(list(p["b"]))[order] * scale
        U = np.zeros((6 * h, 2 * h), np.float32)
        for way in (0, 1):
            for gate in range(3):
                lo = (2 * gate + way) * h
                U[lo:lo + h, way * h:(way + 1) * h] = p["U"][way][:, gate * h:(gate + 1) * h].T
        U *= scale[:, None]
        return W, b[:, None], np.ascontiguousarray(U[:4 * h]), np.ascontiguousarray(U[4 * h:]), p["A"].T.copy()

    def logits(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, net: tuple) -> np.ndarray:
        """Logits of the windows that begin at ``starts`` in rows of inputs and
        end at their text's end at the latest."""
        W, b, gates, cand, attend = net
        h, n = HIDDEN, len(starts)
        inputs = W.T @ words.T + b  # (6h, words): each word is projected once
        at = starts + np.arange(WINDOW)[:, None]
        mask = at < ends
        whole = bool(mask.all())
        if not whole:
            at = np.minimum(at, inputs.shape[1] - 1)
        ahead = np.arange(6 * h) // h % 2 == 0
        g = np.empty((WINDOW, 6 * h, n), np.float32)
        g[:, ahead] = inputs[ahead][:, at].transpose(1, 0, 2)
        g[:, ~ahead] = inputs[~ahead][:, at[::-1]].transpose(1, 0, 2)
        states = np.empty((WINDOW, 2 * h, n), np.float32)
        s = np.zeros((2 * h, n), np.float32)
        for t in range(WINDOW):
            zr = g[t, :4 * h]
            zr += gates @ s
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = g[t, 4 * h:]
            c += cand @ (zr[2 * h:] * s)
            np.tanh(c, out=c)
            z = zr[:2 * h]
            if not whole:
                z[:h] *= mask[t]
                z[h:] *= mask[WINDOW - 1 - t]
            c -= s
            c *= z
            s = s + c
            states[t, :h] = s[:h]
            states[WINDOW - 1 - t, h:] = s[h:]
        e = np.tensordot(self.p["a"], np.tanh(attend @ states), axes=([0], [1]))
        if not whole:
            e = np.where(mask, e, np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        if not whole:
            w = w * mask
        w /= np.maximum(w.sum(axis=0), 1e-9)
        value = np.tensordot(self.p["o"], states, axes=([0], [1]))
        return (w * value).sum(axis=0) + self.p["c"][0]

    def window_logits(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, window number, logit) of all windows, slice by slice."""
        net, rows, starts, ends, owner, number, held, at = self.fused(), [], [], [], [], [], 0, 0

        def flush() -> tuple:
            words = np.concatenate(rows)
            if not len(words):
                words = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
            return tuple(map(np.concatenate, (owner, number))) + (
                self.logits(words, np.concatenate(starts), np.concatenate(ends), net),)

        for i, text in enumerate(texts):
            x = self.inputs(text)
            count = max(1, -(-(len(x) - WINDOW) // STRIDE) + 1)
            for lo in range(0, count, SLICE):
                k = np.arange(lo, min(count, lo + SLICE))
                part = x[lo * STRIDE:k[-1] * STRIDE + WINDOW]
                rows.append(part)
                starts.append(at + (k - lo) * STRIDE)
                ends.append(np.full(len(k), at + len(part)))
                owner.append(np.full(len(k), i))
                number.append(k)
                at += len(part)
                held += len(k)
                if held >= SLICE:
                    yield flush()
                    rows, starts, ends, owner, number, held, at = [], [], [], [], [], 0, 0
        if held:
            yield flush()

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each text's highest window, as a probability."""
        out = np.full(len(texts), -np.inf)
        for owner, _, logit in self.window_logits(texts):
            np.maximum.at(out, owner, logit)
        return sigmoid(out)


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED, batch: int = BATCH) -> Model:
    """Adam on windows of as many documents of either class: random windows
    first, then each document's highest one (multiple-instance training)."""
    y = np.array(labels, np.float32)
    read = [Words.read(t) for t in texts]
    seen, docs = np.unique(np.concatenate([np.unique(w) for w, _, _ in read]), return_counts=True)
    index = np.zeros(WORDS, np.int32)
    index[seen[docs >= MIN_DOCS]] = np.arange(1, (docs >= MIN_DOCS).sum() + 1)
    model, rng = Model(index, seed), np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    each = [np.flatnonzero(y == label) for label in (0, 1)]
    decks: list[list[int]] = [[], []]
    windows = [max(1, -(-(len(w) - WINDOW) // STRIDE) + 1) for w, _, _ in read]
    while step < steps:
        some = []
        for label in (0, 1):  # both classes alike, each reshuffled when it is through
            for _ in range(batch // 2):
                decks[label] = decks[label] or rng.permutation(each[label]).tolist()
                some.append(decks[label].pop())
        rate = 0.02 if step < steps * 2 // 3 else 0.008
        if step < steps * RANDOM:
            offset = np.array([rng.integers(windows[i]) for i in some])
        else:
            owner, number, logit = map(np.concatenate, zip(*model.window_logits([texts[i] for i in some])))
            rank = np.lexsort((-logit, owner))
            offset = number[rank[np.searchsorted(owner[rank], np.arange(len(some)))]]
        x = np.zeros((len(some), WINDOW, WORD_DIM + CHAR_DIM), np.float32)
        mask = np.zeros((len(some), WINDOW), np.float32)
        for j, i in enumerate(some):
            rows = model.inputs(texts[i])[offset[j] * STRIDE:][:WINDOW]
            x[j, :len(rows)], mask[j, :len(rows)] = rows, 1
        x *= rng.random((len(some), WINDOW, 1), dtype=np.float32) >= DROP
        logit, saved = model.forward(x, mask, keep=True)
        grads, dx = model.backward(x, mask, (sigmoid(logit) - y[some]).astype(np.float32) / len(some), saved)
        grads["word"], grads["char"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["char"])
        for j, i in enumerate(some):
            word, pair, at = read[i]
            a = offset[j] * STRIDE
            b = min(a + WINDOW, len(word))
            if b <= a:
                continue
            np.add.at(grads["word"], index[word[a:b]], dx[j, :b - a, :WORD_DIM])
            ends = np.append(at, len(pair))
            n = np.diff(ends)[a:b]
            np.add.at(grads["char"], pair[ends[a]:ends[b]], np.repeat(dx[j, :b - a, WORD_DIM:] / n[:, None], n, axis=0))
        step += 1
        for k, g in grads.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            if k in DECAYED:
                model.p[k] *= np.float32(1 - rate * DECAY)
            model.p[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """Up to ``sample`` documents of each class, none of them held out."""
    marked = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(crc_bucket() != 0))
    ids = None
    for value in (0, 1):
        some = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = some if ids is None else ids.unionByName(some)
    # one text (the least) of an id, however often the id is repeated
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = training_rows(docs, labels, sample)
    share = sum(r.toxic for r in rows) / len(rows) if rows else 0.0
    model = train([r.text for r in rows], [r.toxic for r in rows], steps) if 0 < share < 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            scores = model.scores(texts).astype(np.float64) if model else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return (arrow_map(src, run, "doc_id long, score double").withColumn("held_out", crc_bucket() == 0)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
