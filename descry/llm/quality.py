"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are embedded, filters of WIDTH bytes move over them by STRIDE, overlapping chunks of 2 x HALF
bytes cover the whole document, each filter is max-pooled within each chunk, and the mean and the maximum over the
chunks are combined by one logistic unit. Every byte of every document is seen, whatever the length.

It is fitted on every labelled text outside the held-out fold, by all tasks, whose networks are averaged after each pass.
Nulls and empty texts are one chunk of padding and get a score like any other text. Repeated rows get equal scores.
Without labelled rows of both classes, the score is the known share of class 1 (1.0 if nothing is known).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import beside, buffers, cut, fold, runs, sigmoid, small_batches

WIDTH, STRIDE, DIM, HALF = 16, 4, 8, 256
STEPS, POSITIONS = WIDTH // STRIDE, HALF // STRIDE
#: Bytes that are embedded at a time.
BLOCK = 1 << 18
#: Passes over the labelled rows, rows and about so many bytes of a step, half chunks whose windows are gathered at a time.
EPOCHS, BATCH, BYTES, HALVES = 5, 48, 1 << 22, 1 << 12
#: Labelled rows of a task at least, before there are several; labels that are broadcast.
PART, MOST = 4000, 250_000


@dataclass
class Net:
    embed: np.ndarray  # (256, DIM), row 0 is padding
    filters: np.ndarray  # (WIDTH * DIM, F)
    bias: np.ndarray  # (F,)
    head: np.ndarray  # (2 F + 1,)

    def score(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for i, j in runs(offsets, BLOCK):
            padded, first = layout(offsets[i : j + 1], raw)
            out[i:j] = self._score(padded, first)
        return out

    def _score(self, padded: np.ndarray, first: np.ndarray) -> np.ndarray:
        """In pieces of BLOCK bytes for a very long text; `first` is the first half chunk of each document."""
        half = np.concatenate([self.half_max(padded, first, a)[0] for a in range(0, len(padded), BLOCK)])
        return sigmoid(features(half, first)[0] @ self.head[:-1] + self.head[-1])

    def half_max(self, padded: np.ndarray, first: np.ndarray, a: int, arg: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of the filters in the half chunks from byte `a` on, and where they are; no window reaches into the next document."""
        b = min(len(padded), a + BLOCK)
        e = self.embed[padded[a : min(len(padded), b + WIDTH)]]
        if len(e) < b - a + WIDTH:
            e = np.concatenate([e, np.zeros((b - a + WIDTH - len(e), DIM), np.float32)])
        rows = e.reshape(-1, STRIDE * DIM)
        n = (b - a) // STRIDE
        y = rows[:n] @ self.filters[: STRIDE * DIM]
        for k in range(1, STEPS):
            y += rows[k : n + k] @ self.filters[k * STRIDE * DIM : (k + 1) * STRIDE * DIM]
        y = y.reshape(-1, POSITIONS, y.shape[1])
        last = first[1:] - 1 - a // HALF
        y[last[(last >= 0) & (last < len(y))], 1 - STEPS :] = -np.inf
        m = np.maximum(y.max(axis=1) + self.bias, 0)
        return m, y.argmax(axis=1) if arg else None


def layout(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, each padded with at least WIDTH zeros to whole half chunks, and where each begins."""
    size = np.diff(offsets)
    halves = (size + WIDTH + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)])
    padded = np.zeros(int(first[-1]) * HALF, np.uint8)
    start = first[:-1] * HALF
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[0], offsets[-1]) if len(size) > 1 else None
    if at is None:
        padded[: size[0]] = raw[offsets[0] : offsets[1]]
    else:
        padded[at] = raw[offsets[0] : offsets[-1]]
    return padded, first


def features(half: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and maximum over a document's chunks; a chunk is a half chunk with the next one of the same document."""
    last = first[1:] - 1
    after = np.concatenate([half[1:], half[-1:]])
    after[last] = half[last]
    chunk = np.maximum(half, after)
    n = np.diff(first).astype(np.float32)
    mean = np.add.reduceat(chunk, first[:-1], axis=0) / n[:, None]
    top = np.maximum.reduceat(chunk, first[:-1], axis=0)
    return np.concatenate([mean, top], axis=1), chunk, after


class Descent:
    """Adam on a network: `step` by step here, or from the state that other tasks' steps lead to on average."""

    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]

    def params(self) -> list[np.ndarray]:
        return [self.net.embed, self.net.filters, self.net.bias, self.net.head]

    def state(self) -> np.ndarray:
        """All parameters and moments, one after another."""
        return np.concatenate([x.reshape(-1) for p, mv in zip(self.params(), self.moments, strict=True) for x in (p, *mv)])

    def resume(self, state: np.ndarray, steps: int) -> None:
        at, self.steps = 0, steps
        for p, mv in zip(self.params(), self.moments, strict=True):
            for x in (p, *mv):
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size

    def step(self, encoded: list[np.ndarray], ys: np.ndarray, weight: np.ndarray, epoch: int) -> None:
        """Backpropagation through the pooled maxima only; `ys` and `weight` are the texts' classes and weights."""
        net, filters = self.net, len(self.net.bias)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])])
        padded, first = layout(offsets, np.concatenate(encoded))
        parts = [net.half_max(padded, first, a, True) for a in range(0, len(padded), BLOCK)]
        half, arg = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        f, chunk, after = features(half, first)
        err = (sigmoid(f @ net.head[:-1] + net.head[-1]) - ys) * weight / len(ys)
        grads = [np.concatenate([f.T @ err, [err.sum()]]).astype(np.float32)]
        doc = np.repeat(np.arange(len(ys)), np.diff(first))
        fm, ft = err[:, None] * net.head[None, :filters], err[:, None] * net.head[None, filters:-1]
        top = f[:, filters:]
        gc = (fm / np.diff(first)[:, None])[doc] + ft[doc] * (chunk >= top[doc])
        own_half = half >= after
        gh = np.where(own_half, gc, 0)
        nxt = np.where(own_half, 0, gc)
        gh[1:] += nxt[:-1]
        gh = np.where(half > 0, gh, 0).astype(np.float32)
        dw, db = np.zeros_like(net.filters), np.zeros_like(net.bias)
        de = np.zeros_like(net.embed)
        padded = np.concatenate([padded, np.zeros(WIDTH, np.uint8)])
        for low in range(0, len(gh), HALVES):
            c, k = np.nonzero(np.abs(gh[low : low + HALVES]) > 1e-9)
            c += low
            g = gh[c, k]
            at = (c * HALF + arg[c, k] * STRIDE)[:, None] + np.arange(WIDTH)
            seen = padded[at]
            window = net.embed[seen].reshape(len(c), WIDTH * DIM)
            for j in range(filters):
                mine = k == j
                if mine.any():
                    dw[:, j] += g[mine] @ window[mine]
                    db[j] += g[mine].sum()
            back = (g[:, None] * net.filters.T[k]).reshape(-1, DIM)
            flat = seen.reshape(-1)
            for d in range(DIM):
                de[:, d] += np.bincount(flat, weights=back[:, d], minlength=256)
        de[0] = 0
        self.steps += 1
        lr = self.rate * 0.5 ** max(0, epoch - 2)
        for p, gr, (m, v) in zip(self.params(), [de, dw, db, grads[0]], self.moments, strict=True):
            m += 0.1 * (gr - m)
            v += 0.001 * (gr * gr - v)
            p -= lr * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def start(filters: int, rng: np.random.Generator) -> Net:
    """Random parameters."""
    embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
    embed[0] = 0
    return Net(
        embed, (rng.normal(0, 1, (WIDTH * DIM, filters)) / np.sqrt(WIDTH * DIM) * 1.5).astype(np.float32), np.zeros(filters, np.float32),
        np.append(rng.normal(0, 0.1, 2 * filters), 0).astype(np.float32),
    )


def constant(net: Net, share: float) -> Net:
    """`net`, scoring every text with `share`."""
    net.head[:] = 0
    net.head[-1] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return net


def shifted(net: Net, prior: float) -> Net:
    """`net`, trained with classes of equal weight, for a share of class 1 of `prior`."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.head[-1] += np.log(prior / (1 - prior))
    return net


def train(rows: list[tuple[str, int]], prior: float, filters: int = 24, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 7, batch: int = BATCH) -> Net:
    """A network fitted on `rows` here; `prior` is the known share of class 1."""
    rng = np.random.default_rng(seed)
    descent = Descent(start(filters, rng), rate)
    ys = np.array([y for _, y in rows], np.float32)
    if not len(ys) or ys.min() == ys.max():
        return constant(descent.net, float(ys.mean()) if len(ys) else prior)
    encoded = [np.frombuffer(t.encode(), np.uint8) for t, _ in rows]
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean())).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(rows), batch):
            own = order[b : b + batch]
            descent.step([encoded[i] for i in own], ys[own], weight[own], epoch)
    return shifted(descent.net, prior)


def labelled(docs: DataFrame, labels: DataFrame, label: str, where: Column, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of every row of `docs` with a label, checkpointed, in the order of a hash, so that wherever one reads, there are rows of all sorts.

    `where` restricts the ids (a fold). Of an id's conflicting labels the larger one counts.
    """
    known = labels.where(where & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("_label"))
    known = cut(known.where(F.col("_label").isin(0, 1)))
    n = known.count()
    rows = beside(docs.where(where).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), known, [id_col], "inner", n, MOST)
    rows = rows.select(F.xxhash64(F.lit(11), F.col(id_col), F.col("_text")).alias("_place"), "_text", "_label")
    if n <= MOST:  # a join by shuffle has dealt the ids
        rows = rows.repartition("_place")
    return cut(rows.sortWithinPartitions("_place").select("_text", "_label"))


def passed(rows: DataFrame, descent: Descent, weight: dict[int, float], epoch: int) -> None:
    """One pass over all `rows`: each task goes on from `descent` with its own rows, and `descent` takes their average, weighted by rows."""
    net, state, steps, rate = descent.net, descent.state(), descent.steps, descent.rate

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Descent(Net(*(np.array(x) for x in (net.embed, net.filters, net.bias, net.head))), rate), 0
        own.resume(state, steps)
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            ys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
            for low in range(0, len(ys), BATCH):
                for i, j in runs(offsets[low : low + BATCH + 1], BYTES):
                    i, j = low + i, low + j
                    own.step([raw[a:b] for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)], ys[i:j], np.where(ys[i:j] == 1, weight[1], weight[0]).astype(np.float32), epoch)
            n += len(ys)
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([own.steps]), pa.array([own.state().astype(np.float32).tobytes()])], ["part", "n", "steps", "state"])

    got = sorted(rows.mapInArrow(by_task, "part long, n long, steps long, state binary").collect())
    total = sum(r.n for r in got)
    descent.resume(sum(np.frombuffer(r.state, np.float32) * (r.n / total) for r in got), max(r.steps for r in got))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
    filters: int = 24, rate: float = 0.02, seed: int = 7,
) -> Net:
    """Fit on every labelled text outside the held-out fold, where they lie; the prior counts all labels outside it.

    Up to 2 x PART rows are one task's and are trained on as by `train`; more are dealt over tasks, whose networks are averaged after each epoch.
    """
    where = fold(id_col, folds) != held
    prior = labels.where(where).agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = 1.0 if prior is None else float(prior)
    rows = labelled(docs, labels, label, where, id_col, text_col)
    seen = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    descent, total = Descent(start(filters, np.random.default_rng(seed)), rate), sum(seen.values())
    if len(seen) < 2:
        return constant(descent.net, float(*seen) if seen else prior)
    dealt = rows.coalesce(max(1, min(2 * rows.sparkSession.sparkContext.defaultParallelism, total // PART)))
    for epoch in range(EPOCHS):
        passed(dealt, descent, {c: 0.5 * total / n for c, n in seen.items()}, epoch)
    return shifted(descent.net, prior)


def score_column(net: Net, text: str | Column) -> Column:
    """The probability of class 1 for each whole text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            offsets, raw = buffers(texts)
            yield pa.array(net.score(offsets, raw), pa.float64())

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`; other columns are left aside."""
    small_batches(docs.sparkSession)
    net = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    held, folds = options.get("held", 2), options.get("folds", 4)
    return docs.select(
        id_col, (fold(id_col, folds) == held).alias("held_out"), score_column(net, F.col(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier doesn't reject."""
    small_batches(docs.sparkSession)
    net = fit(docs, labels, text_col=text_col, **options)
    return docs.where(score_column(net, F.col(text_col)) >= threshold)
