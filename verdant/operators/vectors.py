"""Adding up long vectors that tasks make from their rows.

Each task hands on its sum cut into chunks; equal chunks meet in a second stage
that adds them as they stream by.  What a task holds is bounded by the vectors,
not by the rows or the number of tasks, and the driver gets each sum once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

CHUNK = 8192
SCHEMA = "vector int, chunk int, part array<double>"
NAMES = ["vector", "chunk", "part"]


def _record(vector: Sequence[int], chunk: Sequence[int], part: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(vector, pa.int32()), pa.array(chunk, pa.int32()), pa.array(part, pa.list_(pa.float64()))], names=NAMES)


def summed(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], list[np.ndarray]], sizes: Sequence[int],
           opened: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None) -> list[np.ndarray]:
    """The sums over all Arrow batches of the flat vectors that ``of_batch`` gives
    (one of each size); zeros without rows.  One job.  ``opened``: the batches that a
    batch of ``rows`` stands for, if these only name them."""
    spark = rows.sparkSession
    ship_package(spark)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches if opened is None else chain.from_iterable(map(opened, batches)):
            if b.num_rows:
                own = of_batch(b)
                total = own if total is None else [np.add(x, y, out=x) for x, y in zip(total, own)]
        for i, flat in enumerate(total or ()):
            cut = [flat[lo:lo + CHUNK] for lo in range(0, len(flat), CHUNK)]
            yield _record([i] * len(cut), range(len(cut)), cut)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, c, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = part.values.to_numpy()
                total[i, c] = total[i, c] + own if (i, c) in total else own
        if total:
            yield _record([k[0] for k in total], [k[1] for k in total], list(total.values()))

    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(-(-s // CHUNK) for s in sizes))
    got = rows.mapInArrow(parts, SCHEMA).repartition(max(spread, 1), "vector", "chunk").mapInArrow(added, SCHEMA).toArrow()
    out = [np.zeros(s) for s in sizes]
    for i, c, part in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2)):
        own = part.values.to_numpy()
        out[i][c * CHUNK:c * CHUNK + len(own)] = own
    return out
