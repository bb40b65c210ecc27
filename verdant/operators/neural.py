"""An order-aware neural text classifier, trained data-parallel on Spark.

Words become ids by a hash into ``buckets`` rows of an embedding; filters slide over
``WINDOW`` = 3 neighbouring words (with a weight for each place, so the order of words
counts), each filter's largest response over the whole text is a feature, and
a softmax over these gives the class.

Training is synchronous minibatch descent (Adam).  The rows are dealt once, by a
hash of their id, to ``steps`` folders; a step is one Spark job over one folder in
which each Arrow batch adds up its rows' gradients and ``vectors.summed`` the
batches'; parameters go out as a broadcast of a size fixed by the settings.  An
epoch goes over all folders, in an order drawn by (seed, epoch), and ends with a
job that counts the confusion cells and the loss of the validation rows.  Its
parameters are saved as a version of the model store, its figures join the
``history`` table, and ``history.early_stopping`` on that table says when to stop and
which epoch to load.

Cases: a text without words (or null) is classified by the bias alone; long texts go
through the filters in stretches; one class, or no rows, trains but learns only
that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sequence_words
from ..session import scratch_path, ship_package
from ..sources.model_store import ModelStore
from . import history as H
from .vectors import summed

WINDOW = 3
STRETCH = 16384
RUN = 16


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    size: int = 128
    filters: int = 128
    steps: int = 8
    epochs: int = 6
    patience: int = 2
    rate: float = 2e-3
    seed: int = 42


Parameters = dict[str, np.ndarray]


def initial(s: Settings, classes: int) -> Parameters:
    """Row 0 of the embedding is the place outside a text and stays zero."""
    rng = np.random.default_rng(s.seed)
    embedding = 0.1 * rng.standard_normal((s.buckets, s.size))
    embedding[0] = 0
    return {"embedding": embedding, "filter": rng.standard_normal((WINDOW * s.size, s.filters)) * (2 / (WINDOW * s.size)) ** 0.5,
            "filter_bias": np.zeros(s.filters), "out": rng.standard_normal((s.filters, classes)) * s.filters ** -0.5, "out_bias": np.zeros(classes)}


def responses(p: Parameters) -> list[np.ndarray]:
    """What each word at each place of a window adds to each filter's response:
    WINDOW tables of buckets x filters.  A window's response is a sum of WINDOW of
    their rows, so no text is multiplied with the filters."""
    size = p["embedding"].shape[1]
    return [p["embedding"] @ p["filter"][j * size:(j + 1) * size] for j in range(WINDOW)]


def strongest(ids: np.ndarray, tables: list[np.ndarray], places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response (without bias) over a text and, if ``places`` are
    asked for, where it is (the first place).  ``ids`` has a 0 before and after the
    text, so word i stands at i + 1."""
    n, filters = len(ids) - 2, tables[0].shape[1]
    best, where = np.full(filters, -np.inf), np.zeros(filters, dtype=np.int64)
    for lo in range(0, n, STRETCH):
        hi = min(n, lo + STRETCH)
        z = tables[0].take(ids[lo:hi], axis=0)
        for j in range(1, WINDOW):
            z += tables[j].take(ids[lo + j:hi + j], axis=0)
        if not places:
            best = np.maximum(best, z.max(axis=0))
            continue
        at, top = first_largest(z)
        where, best = np.where(top > best, at + lo, where), np.maximum(best, top)
    return best, where


def first_largest(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each column's largest value, and the value.  The largest of
    each ``RUN`` rows say in which of these runs to look."""
    whole, each = len(z) // RUN, np.arange(z.shape[1])
    if not whole:
        at = z.argmax(axis=0)
        return at, z[at, each]
    runs = z[:whole * RUN].reshape(whole, RUN, -1).max(axis=1)
    begin = runs.argmax(axis=0) * RUN
    at = begin + z[begin + np.arange(RUN)[:, None], each].argmax(axis=0)
    top = z[at, each]
    if len(z) > whole * RUN:
        rest = z[whole * RUN:]
        last = rest.argmax(axis=0)
        high = rest[last, each]
        at, top = np.where(high > top, last + whole * RUN, at), np.maximum(top, high)
    return at, top


def forward(ids: np.ndarray, p: Parameters, tables: list[np.ndarray] | None = None, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities, features, and where the filters fire (if ``places`` are asked
    for), of one text's padded ids.  ``tables``: the ``responses`` of the parameters, made once for many texts."""
    if len(ids) > 2:
        features, where = strongest(ids, responses(p) if tables is None else tables, places)
        features = np.maximum(features + p["filter_bias"], 0)
    else:
        features, where = np.zeros(p["out"].shape[0]), np.zeros(p["out"].shape[0], np.int64)
    z = features @ p["out"] + p["out_bias"]
    e = np.exp(z - z.max())
    return e / e.sum(), features, where


def gradient(texts: Sequence[np.ndarray], y: np.ndarray, p: Parameters, tables: list[np.ndarray] | None = None) -> tuple[float, int, Parameters]:
    """Sum of the log losses of padded id arrays, right answers, and the loss's
    gradient.  A text only marks which words its filters fired at; the products
    with the embedding and the filters are taken once for all texts."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    tables = responses(p) if tables is None else tables
    size, each = p["embedding"].shape[1], np.arange(len(p["filter_bias"]))
    fired = [np.zeros_like(t) for t in tables]  # by place: (word, filter), the loss's derivative there
    loss, right = 0.0, 0
    for ids, label in zip(texts, y):
        prob, features, where = forward(ids, p, tables)
        loss -= np.log(max(prob[label], 1e-300))
        right += int(prob.argmax() == label)
        d = prob.copy()
        d[label] -= 1
        g["out"] += np.outer(features, d)
        g["out_bias"] += d
        if len(ids) <= 2:
            continue
        back = (p["out"] @ d) * (features > 0)
        g["filter_bias"] += back
        for j in range(WINDOW):
            fired[j][ids[where + j], each] += back  # one cell a filter: none comes twice
    for j, s in enumerate(fired):
        own = slice(j * size, (j + 1) * size)
        g["filter"][own] = p["embedding"].T @ s
        g["embedding"] += s @ p["filter"][own].T
    g["embedding"][0] = 0
    return loss, right, g


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(x: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def padded(b: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each text between two zeros."""
    col = b.column("ids")
    values, sizes = col.flatten().to_numpy(), col.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [np.concatenate([[0], values[e - n:e], [0]]) for e, n in zip(ends, sizes)]


def with_ids(docs: DataFrame, s: Settings, text_col: str = "text") -> DataFrame:
    """docs with ``ids``: the hashed words of the whole text, 1 .. buckets - 1."""
    words = sequence_words(F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn("ids", F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(s.buckets - 1)) + 1).cast("int")))


@dataclass
class TextModel:
    settings: Settings
    classes: list
    parameters: Parameters

    def score(self, docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
        """(keep..., choice, prob): class number, and the probability of class 1 of two or of the chosen class."""
        spark = docs.sparkSession
        ship_package(spark)
        sent = spark.sparkContext.broadcast(self.parameters)
        rows = with_ids(docs, self.settings, text_col).select(*keep, "ids")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", choice int, prob double"
        two = len(self.classes) == 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = responses(sent.value)
            for b in batches:
                probs = [forward(ids, sent.value, tables, False)[0] for ids in padded(b)]
                best = [int(x.argmax()) for x in probs]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(best, pa.int32()), pa.array([float(x[1] if two else x[k]) for x, k in zip(probs, best)], pa.float64())],
                    names=[*keep, "choice", "prob"])

        return rows.mapInArrow(run, schema)

    def save(self, store: ModelStore, spark, name: str, version: int | None = None, extra: dict | None = None) -> int:
        x = flat(self.parameters)
        chunks = [(i, x[i:i + 8192].tolist()) for i in range(0, len(x), 8192)]
        meta = {"settings": asdict(self.settings), "classes": self.classes, **(extra or {})}
        return store.save(name, {"parameters": spark.createDataFrame(chunks, "at long, part array<double>")}, meta, version)

    @classmethod
    def load(cls, store: ModelStore, name: str, version: int | None = None) -> "TextModel":
        got = store.load(name, version)
        s = Settings(**got.meta["settings"])
        like = initial(s, len(got.meta["classes"]))
        x = np.zeros(sum(v.size for v in like.values()))
        for r in got.tables["parameters"].collect():  # a size fixed by the settings
            x[r["at"]:r["at"] + len(r["part"])] = r["part"]
        return cls(s, got.meta["classes"], shaped(x, like))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.n = rate, 0.0, 0.0, 0

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.n += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return x - self.rate * (self.m / (1 - 0.9 ** self.n)) / (np.sqrt(self.v / (1 - 0.999 ** self.n)) + 1e-7)


def summed_gradient(rows: DataFrame, p: Parameters) -> tuple[float, float, float, np.ndarray]:
    """Loss, right answers, number of rows and flat gradient of rows(y, ids): one job."""
    sent = rows.sparkSession.sparkContext.broadcast(p)
    tables: list[np.ndarray] = []  # of a task, made for its first batch

    def of_batch(b: pa.RecordBatch) -> list[np.ndarray]:
        tables.extend(() if tables else responses(sent.value))
        texts, y = padded(b), b.column("y").to_numpy()
        loss, right, g = gradient(texts, y, sent.value, tables)
        return [np.concatenate([[loss, right, len(y)], flat(g)])]

    try:
        (x,) = summed(rows, of_batch, [3 + sum(v.size for v in p.values())])
    finally:
        sent.destroy()
    return float(x[0]), float(x[1]), float(x[2]), x[3:]


def evaluated(rows: DataFrame, p: Parameters, classes: int) -> tuple[float, np.ndarray]:
    """Loss, and the confusion cells (true, predicted) of rows(y, ids): one job."""
    sent = rows.sparkSession.sparkContext.broadcast(p)
    tables: list[np.ndarray] = []  # of a task, made for its first batch

    def of_batch(b: pa.RecordBatch) -> list[np.ndarray]:
        tables.extend(() if tables else responses(sent.value))
        cells, loss = np.zeros((classes, classes)), 0.0
        for ids, label in zip(padded(b), b.column("y").to_pylist()):
            prob = forward(ids, sent.value, tables, False)[0]
            loss -= np.log(max(prob[label], 1e-7))
            cells[label, prob.argmax()] += 1
        return [np.append(cells.ravel(), loss)]

    try:
        (x,) = summed(rows, of_batch, [classes * classes + 1])
    finally:
        sent.destroy()
    return float(x[-1]), x[:-1].reshape(classes, classes)


HISTORY = "run string, epoch int, accuracy double, val_accuracy double, loss double, val_loss double"


@dataclass
class Trained:
    model: TextModel       # of the best epoch
    history: DataFrame     # run, epoch, accuracy, val_accuracy, loss, val_loss
    cells: DataFrame       # run, epoch, y_true, y_pred, n of the validation rows
    stopped: dict          # early_stopping's row


def train(split: DataFrame, classes: Sequence, store: ModelStore, name: str, s: Settings = Settings()) -> Trained:
    """Trains on split(doc_id, text, label, split); one store version per epoch."""
    spark = split.sparkSession
    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1).cast("int")
    rows = with_ids(split.where(F.col("split").isin("train", "val")), s).select(
        "split", y.alias("y"), "ids", F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(s.steps)).cast("int").alias("step"))
    path = scratch_path(spark, "neural_rows")
    rows.write.partitionBy("split", "step").parquet(path)
    dealt = spark.read.schema("y int, ids array<int>, split string, step int").parquet(path)

    def part(which: str, step: int | None = None) -> DataFrame:
        own = dealt.where(F.col("split") == which)
        return (own if step is None else own.where(F.col("step") == step)).select("y", "ids")

    p, adam, rng = initial(s, len(classes)), Adam(s.rate), np.random.default_rng([s.seed, 1])
    figures, cells, stopped = [], [], None
    for epoch in range(1, s.epochs + 1):
        total = np.zeros(3)  # loss, right, rows as the steps saw them
        for step in rng.permutation(s.steps):
            *seen, g = summed_gradient(part("train", int(step)), p)
            total += seen
            if seen[-1]:
                p = shaped(adam.step(flat(p), g / seen[-1]), p)
        val_loss, val = evaluated(part("val"), p, len(classes))
        n, m = max(total[2], 1), max(val.sum(), 1)
        figures.append((name, epoch, float(total[1] / n), float(np.trace(val) / m), float(total[0] / n), float(val_loss / m)))
        cells += [(name, epoch, i, j, int(val[i, j])) for i in range(len(classes)) for j in range(len(classes)) if val[i, j]]
        TextModel(s, list(classes), p).save(store, spark, name, epoch, {"figures": figures[-1][2:]})
        history = spark.createDataFrame(figures, HISTORY)
        stopped = H.early_stopping(history, patience=s.patience).first().asDict()
        if stopped["stopped_epoch"] is not None:
            break
    return Trained(TextModel.load(store, name, stopped["best_epoch"]), history,
                   spark.createDataFrame(cells, "run string, epoch int, y_true int, y_pred int, n long"), stopped)
