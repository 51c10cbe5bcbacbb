"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

A text becomes an array of symbols (characters), which is cut wherever no piece of the vocabulary holds the two
neighbours side by side, as no merge can cross there. The distinct pre-tokens of a batch stand as ragged rows of one
array; in each round every row applies its leftmost pair of the lowest rank, all rows at once, until none is left. What
survives is counted: a symbol in the vocabulary as one token, any other character as one token a byte.

Short rows, up to WIDE symbols, stand padded in a matrix, each with its leftmost lowest pair in a round. Longer ones are true ragged rows of one
flat array, and a round applies every place of a row's lowest rank, from the left and without overlap, where the merged symbol only makes pairs of
higher ranks (found when the model is read), and the leftmost place alone where it doesn't. So the order of merges is the same, whatever the length.
Nulls count as empty: no tokens. Repeated rows get equal counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import buffers, runs, small_batches

SPACE, WIDE, BLOCK, MEMORY = 0x2581, 48, 1 << 20, 400_000
NONE = np.iinfo(np.int32).max
#: Pairs are hashed into 2**20 slots.
ODD, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)


class Merges:
    """Symbols and pair ranks of a model that has an identity normaliser, a dummy prefix and byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in own}
        chars = sorted({c for p in pieces for c in p})
        #: Symbol 0 is any character outside the vocabulary's pieces; then the characters, then the longer pieces.
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        symbol = {c: i for i, c in enumerate(chars, 1)} | {p: i for i, p in enumerate((p for p in pieces if len(p) > 1), len(chars) + 1)}
        self.known = np.zeros(len(symbol) + 1, bool)
        self.known[[symbol[p] for p in pieces]] = True
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        keys, merged, rank = [], [], []
        beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p, score in pieces.items():
            for k in range(1, len(p)):
                beside[symbol[p[k - 1]], symbol[p[k]]] = True
                if p[:k] in symbol and p[k:] in symbol:
                    keys.append(symbol[p[:k]] << 32 | symbol[p[k:]])
                    merged.append(symbol[p])
                    rank.append(ranks[score])
        keys = np.array(keys, np.int64)
        slot = ((keys.view(np.uint64) * ODD) >> SHIFT).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.most = int(np.bincount(slot).max())
        self.first = np.searchsorted(slot[order], np.arange(1 << 20)).astype(np.int32)
        tail = np.full(self.most, -1)
        self.keys = np.append(keys[order], tail)
        self.merged = np.append(np.array(merged)[order], tail).astype(np.int32)
        self.rank = np.append(np.array(rank)[order], tail).astype(np.int32)
        self.beside = beside
        made_at = np.full(len(symbol) + 1, -1)
        made_at[[symbol[p] for p in pieces]] = [ranks[s] if len(p) > 1 else -1 for p, s in pieces.items()]
        left, right, own_rank = keys >> 32, keys & 0xFFFFFFFF, np.array(rank, np.int64)
        #: Symbols all of whose pairs rank after the merge that made them.
        self.steady = np.ones(len(symbol) + 1, bool)
        self.steady[left[made_at[left] > own_rank]] = False
        self.steady[right[made_at[right] > own_rank]] = False
        self.memory: dict[bytes, int] = {}

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank NONE where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = (key.view(np.uint64) * ODD) >> SHIFT
        at = self.first[at.view(np.int64)]  # where the keys of this slot begin, in a table sorted by slot
        rank, made = np.full(key.shape, NONE, np.int32), np.zeros(key.shape, np.int32)
        for probe in range(self.most):
            hit = self.keys[at + probe] == key
            rank[hit], made[hit] = self.rank[at + probe][hit], self.merged[at + probe][hit]
        return rank, made

    def remembered(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """survivors() of the pre-tokens that no earlier batch had; at most MEMORY of the others are kept at a time."""
        data = symbols.astype(np.int32).tobytes()
        keys = [data[a:b] for a, b in zip((begin * 4).tolist(), ((begin + size) * 4).tolist(), strict=True)]
        out = np.array([self.memory.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(out < 0)
        out[new] = self.survivors(symbols, begin[new], size[new])
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
        self.memory.update((keys[i], int(out[i])) for i in new.tolist() if size[i] <= WIDE)
        return out

    def survivors(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols left of each pre-token that has two symbols or more (all of whose characters are in pieces)."""
        out = np.zeros(len(begin), np.int64)
        wide = size > WIDE
        mine = np.flatnonzero(wide)
        for i, j in runs(np.concatenate([[0], np.cumsum(size[mine])]), BLOCK):
            out[mine[i:j]] = self.by_ragged(symbols, begin[mine[i:j]], size[mine[i:j]])
        rows = np.flatnonzero(~wide)
        for lo, hi in ((1, 8), (8, 16), (16, WIDE)):
            mine = rows[(size[rows] > lo) & (size[rows] <= hi)]
            for k in range(0, len(mine), 1 << 16):
                part = mine[k : k + (1 << 16)]
                out[part] = self.by_rounds(symbols, begin[part], size[part])
        return out

    def by_rounds(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All rows at once. A row's symbols are a linked list; the last column is a sentinel that merges with nothing."""
        total, live = size.copy(), np.arange(len(size))
        width = int(size.max())
        col = np.arange(width + 1, dtype=np.int32)
        row = np.where(col < size[:, None], symbols[np.minimum(begin[:, None] + col, len(symbols) - 1)], 0)
        after = np.where(col + 1 < size[:, None], col + 1, width).astype(np.int32)
        before = np.broadcast_to(np.where(col > 0, col - 1, width).astype(np.int32), row.shape).copy()
        rank, made = np.full(row.shape, NONE, np.int32), np.zeros(row.shape, np.int32)
        rank[:, :-1], made[:, :-1] = self.look(row[:, :-1], row[:, 1:])
        while len(live):
            j = rank.argmin(axis=1)
            k = np.flatnonzero(rank[np.arange(len(live)), j] != NONE)
            if len(k) < 0.6 * len(live):
                live, row, after, before, rank, made, j = (x[k] for x in (live, row, after, before, rank, made, j))
                k = np.arange(len(live))
            j = j[k]
            total[live[k]] -= 1
            gone = after[k, j]
            right, left, new = after[k, gone], before[k, j], made[k, j]
            row[k, j], rank[k, gone], after[k, j], before[k, right] = new, NONE, right, j
            rank[k, j], made[k, j] = self.look(new, row[k, right])
            rank[k, left], made[k, left] = self.look(row[k, left], new)
        return total

    def by_ragged(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All rows at once, laid end to end. A round merges all places of each row's lowest rank."""
        total, live, n = np.zeros(len(size), np.int64), np.arange(len(size)), size.astype(np.int64)
        s = symbols[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int32)
        rank, made = np.full(len(s), NONE, np.int32), np.zeros(len(s), np.int32)
        rank[:-1], made[:-1] = self.look(s[:-1], s[1:])
        while len(live):
            end = np.cumsum(n)
            rank[end - 1] = NONE  # the last symbol of a row has no neighbour
            low = np.minimum.reduceat(rank, end - n)
            done = low == NONE
            if done.any():
                total[live[done]] = n[done]
                stay = np.repeat(~done, n)
                live, low, n, s, rank, made = live[~done], low[~done], n[~done], s[stay], rank[stay], made[stay]
                if not len(live):
                    break
                end = np.cumsum(n)
            hit = np.flatnonzero(rank == np.repeat(low, n))
            opens = np.append(True, np.diff(hit) != 1)
            nth = np.arange(len(hit))
            apart = (nth - np.maximum.accumulate(np.where(opens, nth, 0))) % 2 == 0  # of places that overlap, every other one
            first = np.zeros(len(hit), bool)
            first[np.searchsorted(hit, end - n)] = True
            hit = hit[first | apart & self.steady[made[hit]]]
            s[hit] = made[hit]
            keep = np.ones(len(s), bool)
            keep[hit + 1] = False
            n = n - np.bincount(np.searchsorted(end, hit, side="right"), minlength=len(n))
            s, rank, made = s[keep], rank[keep], made[keep]
            at = hit - np.arange(len(hit))
            at = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            at = at[at < len(s) - 1]
            rank[at], made[at] = self.look(s[at], s[at + 1])
        return total

    def counts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in runs(offsets, BLOCK):
            out[i:j] = self._counts(offsets[i : j + 1], raw)
        return out

    def _counts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        full = size > 0
        if not full.any():
            return np.zeros(len(size), np.int64)
        data = raw[offsets[0] : offsets[-1]]
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = (data & 0xC0) != 0x80
        nth = np.concatenate([[0], np.cumsum(lead)])
        first = nth[offsets - offsets[0]][:-1][full]  # each text's first character
        points[points == 32] = SPACE
        points = np.insert(points, first, SPACE)  # the dummy prefix
        begin = first + np.arange(len(first))
        sym = self.char[points]
        # pre-tokens begin at each text and wherever two neighbours never meet in a piece
        cut = np.ones(len(sym), bool)
        cut[1:] = ~self.beside[sym[:-1], sym[1:]]
        cut[begin] = True
        start = np.flatnonzero(cut)
        n = np.diff(np.append(start, len(sym)))
        # a single character: one token if it's a piece of its own, else one a byte
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        single = np.where(self.known[sym], 1, width)
        tokens = single[start]
        many = np.flatnonzero(n > 1)
        if len(many):
            where, inverse = self.distinct(sym, start[many], n[many])
            at = many[where]
            tokens[many] = self.remembered(sym, start[at], n[at])[inverse]
        total = np.concatenate([[0], np.cumsum(tokens)])
        out = np.zeros(len(size), np.int64)
        text = np.searchsorted(start, np.append(begin, len(sym)))
        out[full] = total[text[1:]] - total[text[:-1]]
        return out

    def distinct(self, sym: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each kind of pre-token, and the kind of each. 64-bit sums of symbols times odd powers find them; clashes are told apart."""
        power = powers(len(sym))
        mixed = (sym.astype(np.uint64) + ODD) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[0][: len(sym)], dtype=np.uint64)])
        code = (total[start + n] - total[start]) * power[1][start] + n.astype(np.uint64)
        _, where, inverse = np.unique(code, return_index=True, return_inverse=True)
        # equal codes must be equal texts: each pre-token is compared with the first of its code
        gap = np.repeat(start - start[where][inverse], n)
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        wrong = np.add.reduceat(sym[at] != sym[at - gap], np.cumsum(n) - n) > 0
        if wrong.any():
            own = np.flatnonzero(wrong)
            inverse[own] = len(where) + np.arange(len(own))
            where = np.append(where, own)
        return where, inverse


class Local(list):
    """A list that stays where it is: functions that use it travel with an empty one."""

    def __reduce__(self):
        return (Local, ())


_POWERS: list[np.ndarray] = Local()


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        size = max(1 << 16, 1 << (n - 1).bit_length())  # the driver, which looks at a few texts only, keeps it small
        rows = np.ones((2, size), np.uint64)
        rows[0, 1:], rows[1, 1:] = base, inverse
        _POWERS[:] = list(np.cumprod(rows, axis=1, dtype=np.uint64))
    return _POWERS


def count_column(text: str | Column, model_file: str) -> Column:
    """The number of tokens of each whole text."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Merges(model_file)
        for texts in batches:
            yield pa.array(own.counts(*buffers(texts)), pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), count_column(text, model_file).alias("n_tokens"))
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
