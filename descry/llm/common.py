"""What the operators share: Arrow text buffers as numpy arrays, fold and checkpoint helpers."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: keeps a batch of long texts within some tens of MB.
ROWS_PER_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, as the texts in it may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without copying the text; a null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off.astype(np.int64), raw


def runs(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose texts hold about `most` bytes together (a longer text stands alone)."""
    out, n, i = [], len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        out.append((i, j))
        i = j
    return out


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id's text, modulo `parts`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(-1))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, one of our own, but only if executors and driver are one process (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "descry-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder, so that lost executors don't repeat its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method for a small logistic regression; the last weight is the intercept."""
    z = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def beside(big: DataFrame, side: DataFrame, on: list[str], how: str, rows: int | None = None, most: int = 250_000) -> DataFrame:
    """Join a checkpointed `side` of a few fixed-width columns: broadcast up to `most` rows (some MB, counted here), shuffled beyond."""
    n = side.count() if rows is None else rows
    return big.join(F.broadcast(side) if n <= most else side, on, how)
