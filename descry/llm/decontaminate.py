"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of BLOCK words, and every two neighbouring blocks are a passage. Passages and benchmark items are TF-IDF
vectors over 2**BITS hashed words, with passage frequencies counted over all documents. A randomised range finder (Halko et al.) with
power iterations, distributed over the executors, gives the leading right singular vectors of the blocks of all documents and all items,
the items weighing ITEMS_WEIGH times as much as the documents; there are fewer of them than items, and words outside the items that go along with theirs in the
documents count too. The iterations multiply by A'A, which one pass over the documents adds up from the pairs of words of each block. Items are scaled to length one in that space. Every passage of every document is compared with every item in it; where a
bound on the cosine already rules an item out, the projection is skipped. A cosine loses length there, so LATENT is below COSINE, the
plain cosine from which on pairs are meant to be found (a test measures how many are). Candidates are then checked word by word: the longest common
subsequence of item and passage (with words on either side, so that the whole item fits) must hold COPY of the item's words, or PARAPHRASE
of them together with ANSWER of the item's rarest fifth, which stands for the answer.

An item of more than LONG words is compared in pieces of about two blocks, each of which leads to the whole item's place. An item of
up to SHORT words can have a small cosine with a passage that holds it, as the rest of the passage weighs too: it is also looked for in
each passage with COPY of its words, and found where a window of one and a half times its length has them in order.

Items are taken in blocks of about ITEMS pieces, and a worker holds one block's index at a time, so that memory is bounded (an item stays whole). Null and empty texts have no passage and are clean; items
without words match nothing. Repeated rows are judged alike; rows that share an id are one document in the result of `search`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm.common import buffers, checkpoint_dir, cut, runs, small_batches
from descry.llm.tokencount import powers

BLOCK, BITS, ITEMS = 24, 16, 512
COSINE, LATENT, COPY, PARAPHRASE, ANSWER = 0.25, 0.17, 0.8, 0.6, 0.75
#: Items of up to SHORT words are also looked for without the cosine; those of more than LONG are compared in pieces.
SHORT, LONG = 16, 3 * BLOCK
#: Words in a larger share of all blocks hardly count.
COMMON = 0.05
#: A word beside the items' is a column if so many blocks of all documents hold it, and this share of them: words must recur to go along with others.
RECURS, SHARE = 25, 0.001
#: How many times as much as all documents the items weigh.
ITEMS_WEIGH = 10
BYTES = 1 << 20
#: Words taken at a time for sums of pairs, sums that a task holds, sums in a row of the Gram matrix's table (if a row of the matrix has fewer).
ENTRIES, HELD, SLAB = 1 << 17, 1 << 23, 1 << 16
SIZE = 1 << BITS

LOWER = np.zeros(256, np.uint8)  # 0: no part of a word
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    LOWER[_c] = _c
LOWER[65:91] = LOWER[97:123]
LOWER[128:] = np.arange(128, 256)


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of the first word of each text and the end). Words are runs of letters and digits without case."""
    data = LOWER[raw[offsets[0] : offsets[-1]]]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)) + 1  # accented Latin capitals
    data[capital] += 0x20
    inside = data > 0
    edge = np.zeros(len(data), bool)
    begin = offsets[:-1] - offsets[0]
    edge[begin[begin < len(data)]] = True  # a word ends with its text
    left = np.ones(len(data), bool)
    left[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (left | edge))
    right = np.ones(len(data), bool)
    right[:-1] = ~inside[1:] | edge[1:]
    end = np.flatnonzero(inside & right) + 1
    power = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(0x51)) * power[0][: len(data)], dtype=np.uint64)])
    h = (total[end] - total[start]) * power[1][start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h, np.searchsorted(start, offsets - offsets[0])


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block, whether the next block belongs to the same text, the text); texts without words have none."""
    n = np.diff(first)
    count = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    more = np.zeros(len(text), bool)
    more[:-1] = text[1:] == text[:-1]
    return first[:-1][text] + k * BLOCK, more, text


def pieces(n: int) -> list[tuple[int, int]]:
    """(first word, end) of the pieces in which an item of n words is compared."""
    parts = 1 if n <= LONG else -(-n // (2 * BLOCK))
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def portions(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The items in runs of at most ITEMS pieces, or of one item."""
    out, total = [], 0
    for item in items:
        raw = np.frombuffer(item[1].encode(), np.uint8)
        n = len(pieces(len(words(np.array([0, len(raw)]), raw)[0])))
        if out and total + n > ITEMS:
            yield out
            out, total = [], 0
        out.append(item)
        total += n
    if out:
        yield out


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(blocks that hold each hashed word, number of blocks) over all documents; SIZE + 1 numbers come to the driver."""

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            for i, j in runs(offsets, BYTES):
                h, first = words(offsets[i : j + 1], raw)
                begin, _, _ = blocks(first)
                if not len(begin):
                    continue
                own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
                b = bucket(h).astype(np.uint16)
                order = np.argsort(b, kind="stable")  # by word, then by block
                b, own = b[order], own[order]
                n += np.bincount(b[np.append(True, (b[1:] != b[:-1]) | (own[1:] != own[:-1]))], minlength=SIZE)
                total += len(begin)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], ["b", "n"])

    got = docs.select(text_col).mapInArrow(by_batch, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE + 1, np.int64)
    for b, n in got:
        out[b] = n
    return out[:-1], int(out[-1])


def weights_of(seen: np.ndarray, total: int) -> np.ndarray:
    """Inverse passage frequency, close to 0 for words in more than COMMON of the blocks."""
    return np.maximum(np.log((total + 1.0) / (seen + 1.0)) + np.log(COMMON), 0.02)


def entries(h: np.ndarray, first: np.ndarray, idf: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, column, value) of the words that have a column; `place` is a hashed word's column or -1. Blocks have length one over all their words."""
    begin, _, _ = blocks(first)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    b = bucket(h)
    norm = np.sqrt(np.add.reduceat(idf[b] ** 2, begin)) + 1e-9
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    known = place[b] >= 0
    return row[known], place[b[known]], (idf[b] / norm.astype(np.float32)[row])[known]


def pairs(row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Every two words of a block, as the smaller column * width + the larger one, and the bits of their product below. These are U, with A'A = U + U'."""
    out = []
    for s in range(BLOCK):
        m = np.flatnonzero(row[s:] == row[: len(row) - s])
        if not len(m):
            break
        x, y, v = col[m], col[m + s], value[m] * value[m + s] * np.float32(1 if s else 0.5)
        out.append((np.minimum(x, y) * width + np.maximum(x, y)).astype(np.uint64) << np.uint64(32) | v.view(np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def summed(packed: np.ndarray) -> np.ndarray:
    """Each code once, with the sum of its values; sorts `packed` in place."""
    if not len(packed):
        return packed
    packed.sort()
    code = packed >> np.uint64(32)
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    total = np.add.reduceat(packed.astype(np.uint32).view(np.float32), start, dtype=np.float64).astype(np.float32)
    return code[start] << np.uint64(32) | total.view(np.uint32)


def gram(texts: DataFrame, idf: np.ndarray, cols: np.ndarray) -> DataFrame:
    """A'A over the blocks of all `texts` (one column) and the hashed words `cols`: (k, code, value), checkpointed, with the sums U of `pairs`.

    Row k holds the codes of some rows of U. Each text is read once. A task adds up what it reads, and hands it on where it is more than HELD sums.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), cols))
    width = max(len(cols), 1)
    slab = max(SLAB // width, 1) * width

    def by_slab(packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, value = (packed >> np.uint64(32)).astype(np.uint32), packed.astype(np.uint32)
        at = np.flatnonzero(np.append(True, code[1:] // slab != code[:-1] // slab)) if len(code) else np.zeros(0, np.int64)
        end = np.append(at[1:], len(code))
        for c in range(0, len(at), 64):
            some = list(zip(at[c : c + 64].tolist(), end[c : c + 64].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(code[i]) // slab for i, _ in some]), pa.array([code[i:j].tobytes() for i, j in some], pa.binary()),
                    pa.array([value[i:j].tobytes() for i, j in some], pa.binary()),
                ],
                ["k", "code", "value"],
            )

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, cols = shared.value
        place = np.full(SIZE, -1, np.int64)
        place[cols] = np.arange(len(cols))
        held, new, n = np.zeros(0, np.uint64), [], 0
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            for i, j in runs(offsets, BYTES):
                row, col, value = entries(*words(offsets[i : j + 1], raw), weigh, place)
                for c in range(0, len(row), ENTRIES):  # from a block's start to another's
                    low, high = np.searchsorted(row, [row[c], row[min(c + ENTRIES, len(row) - 1)]])
                    high = high if c + ENTRIES < len(row) else len(row)
                    new.append(summed(pairs(row[low:high], col[low:high], value[low:high], width)))
                    n += len(new[-1])
                if n > HELD // 2:
                    held, new, n = summed(np.concatenate([held, *new])), [], 0
                    if len(held) > HELD:
                        yield from by_slab(held)
                        held = held[:0]
        yield from by_slab(summed(np.concatenate([held, *new])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total = None, np.zeros(slab)

        def closed() -> Iterator[pa.RecordBatch]:
            if k is not None:
                at = np.flatnonzero(total)
                code = (at + k * slab).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([code.tobytes()]), pa.array([total[at].astype(np.float32).tobytes()])], ["k", "code", "value"])

        for batch in batches:  # in the order of k
            for own, code, value in zip(*(batch.column(c) for c in range(3)), strict=True):
                if own.as_py() != k:
                    yield from closed()
                    k = own.as_py()
                    total[:] = 0
                total[np.frombuffer(code.as_buffer(), np.uint32).astype(np.int64) - k * slab] += np.frombuffer(value.as_buffer(), np.float32)
        yield from closed()

    few, kind = 2 * spark.sparkContext.defaultParallelism, "k long, code binary, value binary"  # a task's sums are many, whatever it reads
    parts = texts.coalesce(few).mapInArrow(by_batch, kind)
    return cut(parts.repartition("k").sortWithinPartitions("k").mapInArrow(add, kind)).coalesce(few)


def gram_product(table: DataFrame, width: int, at: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(A'A of `gram`, the columns `at` of its `width`) times basis, summed over the executors."""
    shared = table.sparkSession.sparkContext.broadcast((at, basis.astype(np.float32)))
    shape, slab = basis.shape, 512

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q = shared.value
        place = np.full(width, -1, np.int64)
        place[at] = np.arange(len(at))
        z, some = np.zeros(shape, np.float32), False
        for batch in batches:
            for code, value in zip(batch.column(0), batch.column(1), strict=True):
                code = np.frombuffer(code.as_buffer(), np.uint32)
                x, y = place[code // np.uint32(width)], place[code % np.uint32(width)]
                known = (x >= 0) & (y >= 0)
                if not known.any():
                    continue
                own, row = np.unique(x[known], return_inverse=True)
                part = np.zeros((len(own), shape[0]), np.float32)
                part[row, y[known]] = np.frombuffer(value.as_buffer(), np.float32)[known]
                z[own] += part @ q
                z += part.T @ q[own]
                some = True
        for k in range(0, shape[0] if some else 0, slab):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([z[k : k + slab].tobytes()])], ["k", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(z, np.float32).astype(np.float64)
                total[k] = total[k] + part if k in total else part
        for k, z in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([z.astype(np.float32).tobytes()])], ["k", "z"])

    got = table.select("code", "value").mapInArrow(by_batch, "k long, z binary").repartition("k").mapInArrow(add, "k long, z binary").collect()
    shared.unpersist()
    out = np.zeros(shape, np.float32)
    for k, z in got:
        out[k : k + slab] = np.frombuffer(z, np.float32).reshape(-1, shape[1])
    return out


def corpus(docs: DataFrame, text_col: str) -> tuple[DataFrame, np.ndarray, int]:
    """(all texts, blocks that hold each hashed word, number of blocks): what the singular vectors are fitted on."""
    return docs.select(F.col(text_col).alias("text")), *frequencies(docs, text_col)


def sample_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray, int]:
    """`corpus` by its former name; no sample is taken."""
    return corpus(docs, text_col)


def columns(own: np.ndarray, seen: np.ndarray, total: int) -> np.ndarray:
    """The hashed words that are columns: `own` and those that recur in the documents."""
    return np.union1d(own, np.flatnonzero(seen >= max(RECURS, SHARE * total)))


def latent(
    spark: SparkSession, fit: tuple[DataFrame, np.ndarray, int], items: list[tuple[int, str]], idf: np.ndarray, rounds: int = 3, seed: int = 5,
    whole: tuple[DataFrame, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, orthonormal basis of the leading right singular vectors over them), fitted on a `corpus` and the items.

    The columns are the items' words and those that recur in the documents. The rank is four fifths of the items' pieces
    (a few items keep all their directions). `whole` is a `gram` and its columns, at least these, where there is one already.
    """
    raw = [t.encode() for _, t in items]
    h, first = words(np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))
    own = np.unique(bucket(h))
    if not len(own):
        return own, np.zeros((0, 0), np.float32)
    texts, seen, total = fit
    cols = columns(own, seen, total)
    table, every = whole or (gram(texts, idf, cols), cols)
    at = np.searchsorted(every, cols)
    share = [len(pieces(n)) for n in np.diff(first).tolist()]
    parts = -(-np.diff(first) // BLOCK)
    rank = min(max(min(sum(share) + 8, 64), 4 * sum(share) // 5), len(cols))
    weight = float(np.sqrt(ITEMS_WEIGH * max(total, 1) / max(int(parts.sum()), 1)))
    place = np.full(SIZE, -1, np.int64)
    place[cols] = np.arange(len(cols))
    row, col, value = entries(h, first, idf.astype(np.float32), place)
    value, start = value * np.float32(weight), np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    q = np.random.default_rng(seed).normal(size=(len(cols), rank)).astype(np.float32)
    for _ in range(rounds):
        z = gram_product(table, len(every), at, q)
        y = np.add.reduceat(q[col] * value[:, None], start, axis=0)
        np.add.at(z, col, y[row] * value[:, None])
        q, _ = np.linalg.qr(z)
    return cols, q.astype(np.float32)


class Index:
    """The items of a block in latent space, and what a worker needs to compare passages with them."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, cols: np.ndarray, basis: np.ndarray):
        raw = [t.encode() for _, t in items]
        h, first = words(np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))
        self.ids = [i for i, _ in items]
        self.idf = idf.astype(np.float32)
        self.sequences = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.rare = [set(s[np.argsort(-idf[bucket(s)], kind="stable")[: -(-len(s) // 5)]].tolist()) for s in self.sequences]
        self.pieces = [(k, a, b) for k, s in enumerate(self.sequences) for a, b in pieces(len(s))]
        q = np.zeros((len(self.pieces), basis.shape[1]), np.float32)
        for k, (item, begin, end) in enumerate(self.pieces):
            s = self.sequences[item][begin:end]
            if len(s):
                v = (basis[np.searchsorted(cols, bucket(s))] * self.idf[bucket(s)][:, None]).sum(axis=0)
                q[k] = v / (np.linalg.norm(v) + 1e-9)
        self.table = (basis @ q.T).astype(np.float32)  # what each word adds to each item's cosine
        self.most = np.zeros(SIZE, np.float32)
        self.row = np.full(SIZE, -1, np.int32)
        self.row[cols] = np.arange(len(cols))
        if self.table.size:
            self.most[cols] = self.table.max(axis=1).clip(0)
        # short items by themselves: the share of an item's words that each word stands for
        self.short = [k for k, s in enumerate(self.sequences) if 0 < len(s) <= SHORT]
        words_of_short = np.unique(bucket(np.concatenate([self.sequences[k] for k in self.short]))) if self.short else np.zeros(0, np.int64)
        self.short_row = np.full(SIZE, -1, np.int32)
        self.short_row[words_of_short] = np.arange(len(words_of_short))
        self.part = np.zeros((len(words_of_short), len(self.short)), np.float32)
        for column, k in enumerate(self.short):
            s = self.sequences[k]
            np.add.at(self.part[:, column], self.short_row[bucket(s)], 1 / len(s))
        self.most_part = np.zeros(SIZE, np.float32)
        if self.part.size:
            self.most_part[words_of_short] = self.part.max(axis=1)

    def match(self, offsets: np.ndarray, raw: np.ndarray) -> list[list[tuple[int, float]]]:
        """For each text, the items that it holds, and the share of their words."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(offsets) - 1)]
        for i, j in runs(offsets, BYTES):
            h, first = words(offsets[i : j + 1], raw)
            begin, more, text = blocks(first)
            if not len(begin) or not len(self.ids):
                continue
            b = bucket(h)
            w = self.idf[b]
            bound, square = np.add.reduceat(w * self.most[b], begin), np.add.reduceat(w * w, begin)
            after = np.flatnonzero(more)
            bound[after], square[after] = bound[after] + bound[after + 1], square[after] + square[after + 1]
            end = np.append(begin, len(h))
            found: dict[tuple[int, int], float] = {}
            likely = np.flatnonzero(bound >= LATENT * np.sqrt(square))
            for c in range(0, len(likely), 4096):
                part = likely[c : c + 4096]
                stop = end[part + 1 + more[part]]
                two = more[part]
                own, place = np.unique(np.concatenate([part, part[two] + 1]), return_inverse=True)
                value = self.products(h, b, begin[own], end[own + 1])
                cosine = value[place[: len(part)]]
                cosine[two] += value[place[len(part) :]]
                cosine /= np.sqrt(square[part])[:, None]
                for p, piece in zip(*np.nonzero(cosine >= LATENT), strict=True):
                    t = text[part[p]]
                    k, low, high = self.pieces[piece]
                    if found.get((t, k), 0) >= 1:
                        continue
                    left, right = self.margins(k, low, high)
                    span = h[max(first[t], begin[part[p]] - left) : min(first[t + 1], stop[p] + right)]
                    found[t, k] = max(found.get((t, k), 0), self.share(k, span))
            if self.short:
                self.match_short(h, b, begin, more, text, end, found)
            for (t, k), share in found.items():
                if share > 0:
                    out[i + t].append((self.ids[k], share))
        return out

    def products(self, h: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each block, what its words add to the products with each item."""
        size = stop - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        known = self.row[b[at]] >= 0
        at, owner = b[at[known]], np.repeat(np.arange(len(start)), size)[known]
        out = np.zeros((len(start), self.table.shape[1]), np.float32)
        if len(at):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[first]] = np.add.reduceat(self.table[self.row[at]] * self.idf[at][:, None], first, axis=0)
        return out

    def margins(self, k: int, low: int, high: int) -> tuple[int, int]:
        """Words before and after a passage that is near words [low, high) of item k, so that the whole item fits and some more."""
        n = len(self.sequences[k])
        if high - low == n:
            return (BLOCK + max(0, n - 2 * BLOCK),) * 2
        return low + BLOCK + n // 4, n - high + BLOCK + n // 4

    def match_short(
        self, h: np.ndarray, b: np.ndarray, begin: np.ndarray, more: np.ndarray, text: np.ndarray, end: np.ndarray,
        found: dict[tuple[int, int], float],
    ) -> None:
        """Add to `found` the short items that stand in a passage, whatever else it holds."""
        bound = np.add.reduceat(self.most_part[b], begin)
        after = np.flatnonzero(more)
        bound[after] += bound[after + 1]
        likely = np.flatnonzero(bound >= COPY - 1e-4)
        for c in range(0, len(likely), 4096):
            part = likely[c : c + 4096]
            stop = end[part + 1 + more[part]]
            size = stop - begin[part]
            at = np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row = self.short_row[b[at]]
            known = row >= 0
            owner = np.repeat(np.arange(len(part)), size)[known]
            seen = np.unique(owner * np.int64(SIZE) + row[known])  # each word once
            owner, row = seen // SIZE, seen % SIZE
            if not len(owner):
                continue
            own, start = np.unique(owner, return_index=True)
            share = np.add.reduceat(self.part[row], start, axis=0)
            for p, column in zip(*np.nonzero(share >= COPY - 1e-4), strict=True):
                k, i = self.short[column], own[p]
                t = text[part[i]]
                if found.get((t, k), 0) >= 1:
                    continue
                found[t, k] = max(found.get((t, k), 0), self.close(k, h[begin[part[i]] : stop[i]]))

    def close(self, k: int, span: np.ndarray) -> float:
        """The largest share of short item k's words in order within a window of one and a half times its length, or 0 below COPY."""
        own = self.sequences[k].tolist()
        wide, words, best = -(-3 * len(own) // 2), span.tolist(), 0.0
        inside = set(own)
        for i, x in enumerate(words):  # the best window begins with a word of the item
            if x in inside:
                best = max(best, subsequence(own, words[i : i + wide]) / len(own))
                if best == 1:
                    break
        return best if best >= COPY else 0.0

    def share(self, k: int, span: np.ndarray) -> float:
        """The share of item k's words in a longest common subsequence, or 0 if that is too little."""
        own = self.sequences[k]
        if not len(own):
            return 0.0
        share = subsequence(own.tolist(), span.tolist()) / len(own)
        if share >= COPY:
            return share
        answer = len(self.rare[k] & set(span.tolist())) / max(len(self.rare[k]), 1)
        return share if share >= PARAPHRASE and answer >= ANSWER else 0.0


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of a longest common subsequence, with the rows of a column as the bits of one number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        u = free & places.get(y, 0)
        free = ((free + u) | (free - u)) & full
    return len(a) - free.bit_count()


def finder(indexes: list):
    """The column function of the broadcast Index objects: text -> array<struct<item_id, share>>. A worker holds one of several at a time."""

    @F.arrow_udf("array<struct<item_id:bigint,share:double>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            hits: list[list[tuple[int, float]]] = [[] for _ in range(len(texts))]
            for index in indexes:
                for own, more in zip(hits, index.value.match(*buffers(texts)), strict=True):
                    own += more
                if len(indexes) > 1:
                    vars(index).pop("_value", None)  # it is read again from the worker's file
            yield pa.array(
                [[{"item_id": i, "share": s} for i, s in sorted(x)] for x in hits],
                pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())])),
            )

    return find


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"):
    """finder() of all items, or None where there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    checkpoint_dir(spark)
    known = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"),
    )
    count = known.count()
    if not count:
        return None
    texts, seen, total = fit = corpus(docs, text_col)
    idf = weights_of(seen, total)
    cols = columns(np.flatnonzero(frequencies(known, "t")[0]), seen, total)
    whole = gram(texts, idf, cols), cols
    parts = -(-count // ITEMS)
    indexes = []
    for p in range(parts):
        items = sorted((r[0], r[1]) for r in known.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect())
        indexes += [spark.sparkContext.broadcast(Index(some, idf, *latent(spark, fit, some, idf, whole=whole))) for some in portions(items)]
    return finder(indexes)


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(id, contaminated, item_ids, best_item, best_share) for every row of `docs`."""
    find = matches(docs, benchmark, id_col, text_col, **names)
    hits = find(F.col(text_col)) if find else F.array().cast("array<struct<item_id:bigint,share:double>>")
    best = F.element_at(F.array_sort(F.transform("hits", lambda x: F.struct((-x["share"]).alias("s"), x["item_id"].alias("i")))), 1)
    got = docs.select(id_col, hits.alias("hits"))
    return got.select(
        id_col, (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.transform("hits", lambda x: x["item_id"])).alias("item_ids"),
        F.when(F.size("hits") > 0, best["i"]).alias("best_item"), F.when(F.size("hits") > 0, -best["s"]).otherwise(F.lit(0.0)).alias("best_share"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    find = matches(docs, benchmark, id_col, text_col, **names)
    return docs.where(F.size(find(F.col(text_col))) == 0) if find else docs
