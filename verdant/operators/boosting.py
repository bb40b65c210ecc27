"""Boosted trees for two classes, second order, by distributed histograms.

Features are cut into bins once (quantiles of the data, at most ``BINS``).  A tree
grows level by level: one grouped aggregate per level gives, for every (node,
feature, bin), the sums of gradient and Hessian and the number of rows; the best
cut of every node follows from these few sums on the driver.  Rows never move:
each task sums its own rows first, so the shuffle carries at most nodes x
features x bins rows a task.  Tasks follow the rows (``TASK_ROWS`` each), so a level over
few rows is one task however many partitions the session asks for.

Gradients and Hessians are summed as whole numbers (multiples of 2^-30, coarser
only beyond 2^32 rows), so the sums, and with them the trees, don't depend on how rows
lie in partitions.  Margins are written every ``WRITE_EVERY`` trees, which bounds both
the lineage and the trees that a pass has to replay.

Two ways to choose cuts:

* ``newton``: gain G^2 / (H + l2) of the children over the parent's, both children with
  a Hessian of at least ``min_hessian``; starts at margin 0;
* ``variance``: by how far the children's mean gradients lie apart (weighted by
  rows), leaves still by a Newton step; starts at the classes' log odds.

Rows of a tree are drawn by a hash of (seed, tree, row), columns per *tree* with
a generator seeded by (seed, tree).  A missing value (null, NaN) goes right.
Ties of gain go to the earlier feature, then the smaller cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

BINS = 255
WRITE_EVERY = 10
#: rows that one task of a level takes: a level is a short job, so it gets tasks by its rows, not by the session's partitions
TASK_ROWS = 1 << 16
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    row_fraction: float = 1.0
    column_fraction: float = 1.0
    l2: float = 1.0
    min_hessian: float = 1.0
    gain: str = "newton"
    bins: int = BINS
    seed: int = 42

    def __post_init__(self):
        if self.gain not in ("newton", "variance"):
            raise ValueError(f"unknown gain {self.gain!r}; choose newton or variance")
        if not 1 <= self.bins <= BINS:
            raise ValueError(f"bins must lie in 1..{BINS}")


@dataclass
class Tree:
    """A complete binary tree: children of node i are 2i + 1 and 2i + 2.
    ``feature`` is -1 at leaves; rows whose bin is over ``cut`` go right."""

    feature: list[int]
    cut: list[int]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [0.0] * n, [0.0] * n)

    def route(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(levels):
            f = feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class BoostedTrees:
    features: list[str]
    cuts: list[list[float]]
    settings: Settings
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees[first:]:
            out += np.array(t.value)[t.route(bins, self.settings.depth)]
        return out

    def binned(self, values: np.ndarray) -> np.ndarray:
        """uint8 bins of a matrix: the number of cuts at or below a value; missing values lie over all cuts."""
        out = np.empty(values.shape, dtype=np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(values[:, j]), len(cuts), np.searchsorted(cuts, values[:, j], side="right"))
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with margin, prob and y_pred."""
        ship_package(rows.sparkSession)
        model = self

        @F.pandas_udf("double")
        def margin(x):
            v = np.array(x.tolist(), dtype=float).reshape(len(x), len(model.features))
            import pandas as pd
            return pd.Series(model.start + model.margins(model.binned(v)))

        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features])
        scored = rows.withColumn("margin", margin(values))
        return scored.withColumn("prob", 1 / (1 + F.exp(-F.col("margin")))).withColumn("y_pred", (F.col("margin") > 0).cast("int"))

    def importances(self, kind: str = "gain") -> list[float]:
        """Share of each feature: mean gain of its cuts (``gain``) or their sum
        (``total_gain``), normalised to sum 1; zeros without a cut."""
        total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
                    count[f] += 1
        each = total / np.maximum(count, 1) if kind == "gain" else total
        return (each / each.sum() if each.sum() > 0 else each).tolist()

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "cuts": self.cuts, "settings": asdict(self.settings), "start": self.start,
                           "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> "BoostedTrees":
        d = json.loads(text)
        return cls(d["features"], d["cuts"], Settings(**d["settings"]), d["start"], [Tree(**t) for t in d["trees"]])


# ------------------------------------------------------------------- sums
def scale_for(n: int) -> float:
    """Whole numbers per unit: sums of n values up to 1 fit a long."""
    return float(2 ** min(30, 62 - max(n, 1).bit_length()))


def drawn(rows: np.ndarray, fraction: float, seed: int, tree: int) -> np.ndarray:
    """The rows (64-bit hashes) that take part in a tree."""
    if fraction >= 1:
        return np.ones(len(rows), dtype=bool)
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2 ** 64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2 ** 53 < fraction


def gradients(y: np.ndarray, margin: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss as whole numbers (held in doubles)."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * scale), np.rint(p * (1 - p) * scale)


def batch_sums(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, columns: Sequence[int]) -> np.ndarray:
    """(node, column, bin, [n, g, h]) of rows at nodes 0..nodes-1 of a level; exact
    for batches of up to 2^22 rows, whose sums doubles hold."""
    out = np.zeros((nodes, len(columns), BINS + 1, 3), dtype=np.int64)
    for k, f in enumerate(columns):
        at = node * (BINS + 1) + bins[:, f]
        for i, w in enumerate((None, g, h)):
            out[:, k, :, i] = np.bincount(at, weights=w, minlength=nodes * (BINS + 1)).reshape(nodes, -1)
    return out


def table_bins(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)


def level_sums(rows: DataFrame, model: BoostedTrees, tree: Tree, level: int, columns: Sequence[int], number: int,
               first: int, scale: float) -> DataFrame:
    """(node, feature, bin, n, g, h): the sums of one level of the tree ``number``
    that is growing, over rows(row, y, bins, margin), whose margins hold the
    trees before ``first``.  node counts from the level's left; g and h in units
    of 1 / scale."""
    s, width, columns = model.settings, len(model.features), list(columns)
    nodes, left = 2 ** level, 2 ** level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((nodes, len(columns), BINS + 1, 3), dtype=np.int64)
        for b in batches:
            use = drawn(b.column("row").to_numpy(), s.row_fraction, s.seed, number)
            bins = table_bins(b, width)[use]
            margin = b.column("margin").to_numpy()[use] + model.margins(bins, first)
            at = tree.route(bins, level)
            here = at >= left  # the others rest in leaves above
            g, h = gradients(b.column("y").to_numpy()[use][here], margin[here], scale)
            total += batch_sums(bins[here], at[here] - left, g, h, nodes, columns)
        n, k, c = np.nonzero(total[..., 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(n.astype(np.int32)), pa.array(np.array(columns, dtype=np.int32)[k]), pa.array(c.astype(np.int32)),
             *(pa.array(total[n, k, c, i]) for i in range(3))], names=["node", "feature", "bin", "n", "g", "h"])

    ship_package(rows.sparkSession)
    parts = rows.mapInArrow(run, "node int, feature int, bin int, n long, g long, h long")
    # nodes x columns x bins rows a task at most: they meet in few partitions whatever the session's number
    few = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes)
    return parts.repartition(few, "node", "feature", "bin").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])


def best_cut(sums: np.ndarray, columns: Sequence[int], s: Settings) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, cut, left sums, right sums) of one node's (column, bin,
    [n, G, H]) sums; None if no cut gains."""
    total = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total - left
    (nl, gl, hl), (nr, gr, hr) = np.moveaxis(left, -1, 0), np.moveaxis(right, -1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if s.gain == "newton":
            of = lambda g, h: g * g / (h + s.l2)
            gain = (of(gl, hl) + of(gr, hr) - of(total[1], total[2])) / 2
            ok = (hl >= s.min_hessian) & (hr >= s.min_hessian)
        else:
            gain = nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2
            ok = np.ones(gain.shape, dtype=bool)
    gain = np.where(ok & (nl > 0) & (nr > 0), gain, -np.inf)
    k, c = np.unravel_index(np.argmax(gain), gain.shape)  # the first of equal ones
    if not gain[k, c] > LEAST_GAIN:
        return None
    return float(gain[k, c]), int(columns[k]), int(c), left[k, c], right[k, c]


def leaf(total: np.ndarray, s: Settings) -> float:
    l2 = s.l2 if s.gain == "newton" else 0.0
    return float(-s.step * total[1] / (total[2] + l2)) if total[2] + l2 > 0 else 0.0


def tree_columns(s: Settings, width: int, number: int) -> list[int]:
    """The columns of a tree: floor(fraction * width) of them, at least one."""
    take = max(1, int(s.column_fraction * width))
    return sorted(np.random.default_rng([s.seed, number]).permutation(width)[:take].tolist())


def grow(s: Settings, width: int, number: int, sums_of) -> Tree:
    """One tree; ``sums_of(tree, level, columns)`` gives a level's sums as an
    array (node, column, bin, [n, G, H]), in units of 1."""
    tree, columns = Tree.empty(s.depth), tree_columns(s, width, number)
    open_nodes = [0]
    for level in range(s.depth):
        sums = sums_of(tree, level, columns)
        below = []
        for i in open_nodes:
            own = sums[i - (2 ** level - 1)]
            if level == 0:
                tree.value[0] = leaf(own[0].sum(axis=0), s)
            cut = best_cut(own, columns, s)
            if cut is None:
                continue
            tree.gain[i], tree.feature[i], tree.cut[i], *sides = cut
            for child, side in zip((2 * i + 1, 2 * i + 2), sides):
                tree.value[child] = leaf(side, s)
                below.append(child)
        open_nodes = below
        if not open_nodes:
            break
    return tree


# -------------------------------------------------------------------- fit
def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """At most bins - 1 cuts of each feature, by approximate quantiles: a value of
    the data each, all of them if there are few."""
    shares = [float(i) / bins for i in range(1, bins)] if bins > 1 else [0.5]
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    got = rows.agg(*[F.percentile_approx(clean(c), shares, 10_000).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(x or [])) for x in got]


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "boost_rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binned_rows(rows: DataFrame, model: BoostedTrees, label: str, key: str) -> DataFrame:
    """(row, y, bins, margin): the hash of the key, the label, one byte a feature, the start."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in model.features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            bins = model.binned(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("y"), pa.array([x.tobytes() for x in bins], pa.binary()), pa.array(np.full(b.num_rows, model.start))],
                names=["row", "y", "bins", "margin"])

    ship_package(rows.sparkSession)
    return rows.select(F.xxhash64(key).alias("row"), F.col(label).cast("double").alias("y"), values.alias("x")).mapInArrow(
        run, "row long, y double, bins binary, margin double")


def moved(rows: DataFrame, model: BoostedTrees, first: int) -> DataFrame:
    """rows with the trees from ``first`` on added to their margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now = b.column("margin").to_numpy() + model.margins(table_bins(b, len(model.features)), first)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "y", "bins")), pa.array(now)], names=["row", "y", "bins", "margin"])

    return rows.mapInArrow(run, rows.schema)


def fit(rows: DataFrame, features: Sequence[str], label: str = "y_true", key: str = "doc_id", settings: Settings = Settings()) -> BoostedTrees:
    """Boosted trees of rows whose ``label`` is 0 or 1; rows with another or no
    label are an error, an empty table gives a model of its start alone."""
    s = settings
    per = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()} if label else {}
    if set(per) - {0, 1}:
        raise ValueError(f"labels must be 0 or 1, found {sorted(map(str, per))[:5]}")
    n, ones = sum(per.values()), per.get(1, 0)
    model = BoostedTrees(list(features), quantile_cuts(rows, features, s.bins), s)
    if s.gain == "variance" and n:
        share = min(max(ones / n, 1e-9), 1 - 1e-9)
        model.start = float(np.log(share / (1 - share)))
    if not n:
        return model
    scale = scale_for(n)
    now = _written(binned_rows(rows, model, label, key).repartition(n // TASK_ROWS + 1))
    first = 0
    for number in range(s.rounds):
        def sums_of(tree, level, columns, now=now, first=first):
            out = np.zeros((2 ** level, len(columns), BINS + 1, 3))
            place = {f: k for k, f in enumerate(columns)}
            for r in level_sums(now, model, tree, level, columns, number, first, scale).collect():  # nodes x columns x bins at most
                out[r["node"], place[r["feature"]], r["bin"]] = (r["n"], r["g"] / scale, r["h"] / scale)
            return out

        model.trees.append(grow(s, len(features), number, sums_of))
        if len(model.trees) - first >= WRITE_EVERY and number + 1 < s.rounds:
            now, first = _written(moved(now, model, first)), len(model.trees)
    return model
