"""Fusion weights fitted to labelled detections by gradient steps over all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deepledger.functions import constants as K

#: Rows of a block, which a task multiplies at once; bounds its memory, not what it reads.
BLOCK_ROWS = 1 << 16
#: Different rows up to which one task takes all steps; beyond it each step is a job over the tasks that hold them. Both take the same steps.
ONE_TASK_ROWS = 1 << 18
#: Bounds of the logit.
LOGIT = 30.0


def _blocks(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(block, n): signals, label and frequency of n different rows as one matrix of doubles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            whole = np.concatenate(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary()), pa.array([len(whole)], pa.int64())], names=["block", "n"])

        for batch in batches:
            parts.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)], axis=1))
            if sum(map(len, parts)) >= BLOCK_ROWS:
                yield block()
        if sum(map(len, parts)):
            yield block()

    number = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names]
    label = F.col("label").cast("double")
    known = rows.where(label.isNotNull() & ~F.isnan(label)).select(*number, label.alias("label"))
    times = known.groupBy(*names, "label").agg(F.count("*").cast("double").alias("times"))
    return times.mapInArrow(work, "block binary, n long")


def gradient(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over the rows of a block of the error's slope times each signal, one, and the linear term, with the rows' number last; at: weights, intercept, gain."""
    x, y, times = m[:, :-2], m[:, -2], m[:, -1]
    linear = at[-2] + x @ at[:-2]
    p = 1.0 / (1.0 + np.exp(-np.clip(at[-1] * linear, -LOGIT, LOGIT)))
    slope = (p - y) * p * (1.0 - p) * times
    return np.concatenate([x.T @ slope, [slope.sum(), (slope * linear).sum(), times.sum()]])


def _step(at: np.ndarray, total: np.ndarray, rate: float) -> np.ndarray:
    return at - rate * total[:-1] / max(total[-1], 1.0)


def fit_fusion(rows: DataFrame, names: Sequence[str] = tuple(K.FUSION_WEIGHTS), epochs: int = 400, rate: float = 0.5, one_task: int = ONE_TASK_ROWS) -> dict[str, float]:
    """Weights by signal, intercept and gain of a logistic fusion, from rows of the signals and `label` (0 to 1).

    Each epoch is one step down the squared error of all rows: weights and intercept start at 0, the gain at 1. Equal rows are
    counted first, with partial sums before the shuffle, and the different ones packed into blocks of doubles. Up to one_task of
    these, a task takes all steps; otherwise an epoch is a job that sums the blocks of each task before the tasks' sums, of
    a few numbers each, meet. A signal that is null or not a number counts as 0. Rows without a label, and other columns, are
    left out; repeated rows count each time. Without rows nothing moves.
    """
    width = len(names) + 2
    start = np.array([0.0] * (width - 1) + [1.0])
    schema = ", ".join(f"s{i} double" for i in range(width + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for data in batch["block"]:
                yield np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width)

    def row(values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in values], names=[f"s{i}" for i in range(width + 1)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = list(read(batches)), start
        for _ in range(epochs if held else 0):
            at = _step(at, sum(gradient(m, at) for m in held), rate)
        yield row(np.append(at, 0.0))

    def one_epoch(at: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield row(sum((gradient(m, at) for m in read(batches)), np.zeros(width + 1)))

        sums = blocks.select("block").mapInArrow(work, schema).agg(*[F.sum(f"s{i}") for i in range(width + 1)])
        return _step(at, np.array(sums.first(), float), rate)

    blocks = _blocks(rows, names).persist()
    size, at = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], start
    if 0 < size <= one_task:
        at = np.array(blocks.select("block").coalesce(1).mapInArrow(whole, schema).first(), float)[:-1]
    elif size:
        for _ in range(epochs):
            at = one_epoch(at)
    blocks.unpersist()
    return dict(zip(names, at[:-2].tolist())) | {"intercept": float(at[-2]), "gain": float(at[-1])}
