"""Linear classifiers, any number of them fitted together.

All of them minimise  |w|^2 / 2 + sum of row losses  over one table of sparse rows
(label, index, value):

* ``logistic``: log loss, two classes, rows weighted by class, intercept free of the
  penalty; with more classes the softmax loss over one coefficient row a class;
* ``squared_hinge``: max(0, 1 - m)^2, the intercept is a penalised coefficient like
  the others; one problem per class beyond two classes.

The optimiser is a trust-region Newton method whose steps come from conjugate
gradients, so it only ever needs a value with its gradient, or the Hessian times
a direction, at given coefficients.  Each problem is a generator that asks for one
of the two; one pass over the rows answers the open requests of *all* problems.
The rows are written once with their entries as bytes (``packed``).  A pass is one
Spark job over them, whose tasks read the files' row groups themselves (``groups_of``): coefficients go out as a broadcast (their number is
bounded by ``MAX_COEFFICIENTS``), each task adds up its rows' part, and the parts
are added up in a second stage (``vectors.summed``).
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .vectors import summed

MAX_COEFFICIENTS = 20_000_000
# bytes of a row group of the packed rows
GROUP_BYTES = 16 << 20
VALUE, CURVE = "value", "curve"

Request = tuple[str, np.ndarray, np.ndarray | None]


# ----------------------------------------------------------------- losses
@dataclass(frozen=True)
class Problem:
    """One coefficient matrix (outputs x (features + intercept)) to be fitted.
    ``target``: the class (a number) that counts as positive; ``weights``: of rows by class."""

    kind: str
    classes: int
    target: int = 1
    weights: tuple[float, ...] = ()
    c: float = 1.0

    @property
    def outputs(self) -> int:
        return self.classes if self.kind == "softmax" else 1

    def penalty(self, features: int) -> np.ndarray:
        mask = np.ones((self.outputs, features + 1))
        if self.kind != "squared_hinge":
            mask[:, -1] = 0.0
        return mask

    def _rows(self, y: np.ndarray) -> np.ndarray:
        return self.c * np.array(self.weights)[y] if self.weights else np.full(len(y), self.c)

    def value(self, z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss of the outputs z (rows x outputs) and its derivative by them."""
        s = self._rows(y)
        if self.kind == "softmax":
            top = z.max(axis=1, keepdims=True)
            e = np.exp(z - top)
            total = e.sum(axis=1, keepdims=True)
            d = e / total
            at = np.arange(len(y))
            loss = (s * (np.log(total[:, 0]) + top[:, 0] - z[at, y])).sum()
            d[at, y] -= 1
            return float(loss), d * s[:, None]
        t = np.where(y == self.target, 1.0, -1.0)
        m = t * z[:, 0]
        if self.kind == "logistic":
            p = 1 / (1 + np.exp(-np.abs(m)))
            wrong = np.where(m >= 0, 1 - p, p)  # probability of the other class
            return float((s * (np.maximum(-m, 0) + np.log1p(np.exp(-np.abs(m))))).sum()), (-s * t * wrong)[:, None]
        short = np.maximum(1 - m, 0)
        return float((s * short * short).sum()), (-2 * s * t * short)[:, None]

    def curve(self, z: np.ndarray, dz: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Second derivative by the outputs, times the direction dz."""
        s = self._rows(y)
        if self.kind == "softmax":
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            return s[:, None] * p * (dz - (p * dz).sum(axis=1, keepdims=True))
        if self.kind == "logistic":
            p = 1 / (1 + np.exp(-np.abs(z[:, 0])))
            return (s * p * (1 - p))[:, None] * dz
        t = np.where(y == self.target, 1.0, -1.0)
        return 2 * (s * (t * z[:, 0] < 1))[:, None] * dz


def problems_of(name: str, classes: int, counts: Sequence[int]) -> list[Problem]:
    """The problems of a classifier: ``logreg`` (balanced class weights) or ``svm``."""
    if name == "logreg":
        n = sum(counts)
        weights = tuple(n / (classes * c) if c else 0.0 for c in counts)
        return [Problem("logistic" if classes <= 2 else "softmax", classes, weights=weights)]
    if name == "svm":
        return [Problem("squared_hinge", classes, target=k) for k in ([1] if classes <= 2 else range(classes))]
    raise ValueError(f"unknown linear model {name!r}; choose logreg or svm")


# -------------------------------------------------------------- optimiser
def newton(shape: tuple[int, int], mask: np.ndarray, tol: float, max_iter: int) -> Generator[Request, object, dict]:
    """Trust-region Newton from zero until the gradient's norm is at most
    ``tol`` times that at zero.  Yields requests; returns coefficients and figures."""
    w = np.zeros(shape)
    f, g = yield VALUE, w, None
    start = norm = np.linalg.norm(g)
    radius, steps = norm, 0
    while norm > tol * start and steps < max_iter:
        steps += 1
        # conjugate gradients inside the trust region
        s, r = np.zeros(shape), -g
        d, rr = r.copy(), float((r * r).sum())
        limit, edge = min(0.1, np.sqrt(norm / start)) * norm, False
        for _ in range(2 * w.size):
            if np.sqrt(rr) <= limit:
                break
            hd = (yield CURVE, w, d) + mask * d
            bend = float((d * hd).sum())
            step = rr / bend if bend > 0 else np.inf
            if not np.isfinite(step) or np.linalg.norm(s + step * d) >= radius:
                # to the edge: the positive root of |s + a d| = radius
                a, b, c = float((d * d).sum()), float((s * d).sum()), float((s * s).sum()) - radius ** 2
                step, edge = (-b + np.sqrt(max(b * b - a * c, 0.0))) / a, True
            s, r = s + step * d, r - step * hd
            if edge:
                break
            now = float((r * r).sum())
            d, rr = r + now / rr * d, now
        # the model's gain: -g.s - s.Hs/2, where Hs = -g - r
        gain = -0.5 * float((s * (g - r)).sum())
        f2, g2 = yield VALUE, w + s, None
        share = (f - f2) / gain if gain > 0 else -1.0
        size = np.linalg.norm(s)
        if steps == 1:
            radius = min(radius, size) if share < 0.75 else radius
        if share < 0.25:
            radius = 0.25 * size
        elif share > 0.75 and edge:
            radius *= 2.5
        if share > 1e-4:
            w, f, g = w + s, f2, g2
            norm = np.linalg.norm(g)
        elif size <= 1e-14 * (1 + np.linalg.norm(w)):
            break  # no representable improvement
    return {"coefficients": w, "loss": f, "norm": norm, "start": start, "steps": steps}


def batch_parts(b: pa.RecordBatch, requests: list[tuple[Problem, Request]], features: int) -> list[tuple[float, np.ndarray]]:
    """(value or 0, gradient or Hessian-vector part) of each request over one batch."""
    y, index, value, sizes = entries(b)
    index = index.astype(np.int64)  # once, not at every look-up
    out = []
    for problem, (kind, w, d) in requests:
        z = outputs(index, value, sizes, w)
        loss = 0.0
        if kind == VALUE:
            loss, r = problem.value(z, y)
        else:
            r = problem.curve(z, outputs(index, value, sizes, d), y)
        part = np.empty((w.shape[0], features + 1))
        for k in range(w.shape[0]):
            part[k, :-1] = np.bincount(index, weights=value * np.repeat(r[:, k], sizes), minlength=features)
            part[k, -1] = r[:, k].sum()
        out.append((loss, part))
    return out


def entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class numbers, the entries of the sparse rows (arrays, or ``packed``), index
    and value, and how many each row has."""
    if pa.types.is_list(b.column("index").type):
        index, sizes = b.column("index").flatten().to_numpy(), b.column("index").value_lengths().to_numpy(zero_copy_only=False)
        value = b.column("value").flatten().to_numpy()
    else:
        (index, sizes), (value, _) = numbers_of(b.column("index"), np.int32), numbers_of(b.column("value"), np.float64)
    return b.column("y").to_numpy(), index, value, sizes


def rows_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class numbers, and the entries of the sparse rows: index, value, row."""
    y, index, value, sizes = entries(b)
    return y, index, value, np.repeat(np.arange(b.num_rows), sizes)


def numbers_of(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that lie in the bytes of a binary column, and how many each row has."""
    _, at, data = column.cast(pa.binary()).buffers()
    width = np.dtype(kind).itemsize
    at = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1]
    if at[0] == at[-1]:
        return np.empty(0, kind), np.diff(at)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind), np.diff(at) // width


def packed(rows: DataFrame) -> DataFrame:
    """rows(y, index, value) with the arrays as bytes, written once: a pass then takes
    them as they lie, without a step for each entry."""
    spark = rows.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                at = np.append(0, np.cumsum(b.column("index").value_lengths().to_numpy(zero_copy_only=False)))
                cols = []
                for name, kind in (("index", np.int32), ("value", np.float64)):
                    numbers = np.ascontiguousarray(b.column(name).flatten().to_numpy(), kind)
                    offsets = (at * numbers.itemsize).astype(np.int32)
                    cols.append(pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(numbers)]))
                yield pa.RecordBatch.from_arrays([b.column("y"), *cols], names=["y", "index", "value"])

    path = scratch_path(spark, "packed")
    # hardly two rows are alike: as they are, in groups that a task reads one after another
    (rows.select("y", "index", "value").mapInArrow(run, "y int, index binary, value binary").write
     .option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", GROUP_BYTES).parquet(path))
    return spark.read.schema("y int, index binary, value binary").parquet(path)


def groups_of(rows: DataFrame) -> DataFrame | None:
    """(file, row_group) of every row group of the files under ``packed`` rows, dealt
    evenly to the tasks; None where Arrow can't open their folder.  A pass over these
    reads the bytes in the task itself, past Spark's rows."""
    spark = rows.sparkSession
    groups = []
    try:
        for uri in rows.inputFiles():  # at most one for each task that wrote
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                groups += [(uri, g) for g in range(pq.ParquetFile(f).num_row_groups)]
    except (OSError, ValueError, NotImplementedError):
        return None
    tasks = max(min(len(groups), spark.sparkContext.defaultParallelism), 1)
    return spark.createDataFrame(spark.sparkContext.parallelize(groups, tasks), "file string, row_group int")


def read_groups(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of the row groups named by b(file, row_group), a few at a time."""
    for uri, group in zip(b.column("file").to_pylist(), b.column("row_group").to_pylist()):
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(1024, row_groups=[group])


def outputs(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(rows x outputs): each row's sum of value * coefficient, and the intercept."""
    some = np.flatnonzero(sizes)
    begin = np.cumsum(sizes)[some] - sizes[some]
    z = np.zeros((len(sizes), len(w)))
    if len(some):
        for j, k in enumerate(w):
            z[some, j] = np.add.reduceat(k.take(index) * value, begin)
    return z + w[:, -1]


def one_pass(rows: DataFrame, requests: list[tuple[Problem, Request]], features: int, groups: DataFrame | None = None) -> list[tuple[float, np.ndarray]]:
    """Answers of all requests over rows(y, index, value): one job.  With ``groups``
    of the files of the rows, the tasks read these."""
    sent = rows.sparkSession.sparkContext.broadcast(requests)

    def of_batch(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.append(part.ravel(), loss) for loss, part in batch_parts(b, sent.value, features)]

    sizes = [w.size + 1 for _, (_, w, _) in requests]
    try:
        flat = summed(rows, of_batch, sizes) if groups is None else summed(groups, of_batch, sizes, read_groups)
    finally:
        sent.destroy()
    return [(float(x[-1]), x[:-1].reshape(w.shape)) for x, (_, (_, w, _)) in zip(flat, requests)]


def fit(rows: DataFrame, problems: Sequence[Problem], features: int, tol: float = 1e-4, max_iter: int = 100, passes: list | None = None) -> list[dict]:
    """Fits all problems over rows(y int, index array<int>, value array<double>).
    Each result: coefficients, loss, norm and start (of the gradient), steps.
    ``passes``, if given, collects how many problems each pass served."""
    size = sum(p.outputs for p in problems) * (features + 1)
    if size > MAX_COEFFICIENTS:
        raise ValueError(f"{size} coefficients are more than {MAX_COEFFICIENTS}; set max_features")
    masks = [p.penalty(features) for p in problems]
    running = {i: newton((p.outputs, features + 1), masks[i], tol, max_iter) for i, p in enumerate(problems)}
    asked: dict[int, Request] = {i: next(g) for i, g in running.items()}
    done: dict[int, dict] = {}
    rows = packed(rows)
    groups = groups_of(rows)
    while asked:
        order = sorted(asked)
        if passes is not None:
            passes.append(len(order))
        answers = one_pass(rows, [(problems[i], asked[i]) for i in order], features, groups)
        for i, (loss, part) in zip(order, answers):
            kind, w, _ = asked[i]
            reply = (loss + 0.5 * float((masks[i] * w * w).sum()), part + masks[i] * w) if kind == VALUE else part
            try:
                asked[i] = running[i].send(reply)
            except StopIteration as end:
                done[i] = end.value
                del asked[i]
    return [done[i] for i in range(len(problems))]


# -------------------------------------------------------------------- model
@dataclass
class LinearModel:
    """Coefficients (outputs x (features + intercept)) of a named classifier."""

    name: str
    classes: list
    coefficients: np.ndarray

    def decide(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and probabilities: of class 1 of two, else of the
        chosen class; nan where the model gives none (hinge beyond two classes)."""
        if z.shape[1] == 1:
            return (z[:, 0] > 0).astype(np.int64), 1 / (1 + np.exp(-z[:, 0]))
        best = z.argmax(axis=1)
        if self.name == "svm":
            return best, np.full(len(z), np.nan)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return best, e[np.arange(len(z)), best] / e.sum(axis=1)


def fit_models(rows: DataFrame, names: Sequence[str], classes: Sequence, features: int, counts: Sequence[int],
               tol: float = 1e-4, max_iter: int = 100, passes: list | None = None) -> list[LinearModel]:
    """The named classifiers, fitted together."""
    each = [problems_of(n, len(classes), counts) for n in names]
    results = fit(rows, [p for ps in each for p in ps], features, tol, max_iter, passes)
    out = []
    for name, ps in zip(names, each):
        own, results = results[:len(ps)], results[len(ps):]
        out.append(LinearModel(name, list(classes), np.vstack([r["coefficients"] for r in own])))
    return out


def score(rows: DataFrame, models: Sequence[LinearModel], keep: Sequence[str]) -> DataFrame:
    """(model, keep..., choice, prob): every model's class number for every row, one pass."""
    spark = rows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(list(models))
    schema = "model string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields) + ", choice int, prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, index, value, sizes = entries(b)
            for m in sent.value:
                choice, prob = m.decide(outputs(index, value, sizes, m.coefficients))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m.name] * b.num_rows), *(b.column(c) for c in keep), pa.array(choice.astype(np.int32)),
                     pa.array(prob, mask=np.isnan(prob))], names=["model", *keep, "choice", "prob"])

    return rows.select(*keep, F.lit(0).alias("y"), "index", "value").mapInArrow(run, schema)
