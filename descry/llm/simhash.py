"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees over shards of fingerprints.

A fingerprint has 64 bits; each is set if it is set in over half the XXH64 hashes (seed 42) of a text's word shingles.
Random fingerprints lie around 32 bits apart, all about as far from any vantage point, so that triangle bounds of radius 3
prune nothing at the top of one tree over all of them (see README). The shards therefore begin with a bound that does prune:
of BLOCKS blocks of bits, two fingerprints within RADIUS = 3 bits agree on at least BLOCKS - 3 whole ones, so each fingerprint
goes to a shard for every choice of BLOCKS - 3 blocks. Within a shard, a vantage-point tree splits by Hamming distance, and
members within the radius of a boundary visit the other side. Shards above HOT members are first dealt over the cells between rings
around two vantage points in Spark, with the same visits. A shard passes on only a spanning forest of its links, and components are found
over distinct fingerprints, so that thousands of copies cost one row.

Nulls, empty texts and texts without words have fingerprint zero, and link like any other. Repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import checkpoint_dir, cut, small_batches
from descry.llm.components import components

RADIUS, BLOCKS, SEED = 3, 5, 42
#: A tree's leaves hold up to LEAF fingerprints; shards above HOT are dealt in Spark first; BLOCK rows are compared at a time.
LEAF, HOT, MANY, BLOCK = 32, 20_000, 1 << 18, 1024
WIDTHS = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]


def hashes(text: str, shingle: int) -> np.ndarray:
    """The unsigned hashes of a text's word shingles, repeats included; a text of fewer words is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(words))
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    n, digest, out = len(words) - size + 1, xxhash.xxh64_intdigest, []
    for k in range(0, n, MANY):
        pairs = zip(begin[k : min(n, k + MANY)].tolist(), end[k + size - 1 : min(n, k + MANY) + size - 1].tolist(), strict=True)
        out.append(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))
    return np.concatenate(out)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), MANY):
        ones += np.unpackbits(h[k : k + MANY].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    return majority(hashes(text, shingle))


def fingerprint_column(text: str | Column, shingle: int = 3) -> Column:
    """The fingerprint of each whole text, as a signed long of the same bits."""

    @F.arrow_udf("bigint")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t or "", shingle) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())

    return fp(text)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, whose words are the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def leaves(
    fp: np.ndarray, own: np.ndarray, guests: np.ndarray, radius: int, leaf: int = LEAF, pruned: list[int] | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaves of a vantage-point tree: places of `fp` (rows of words) of the members, and of the guests that can be within `radius` of one.

    Of two members in different leaves, one is a guest of the other's leaf unless a boundary tells that they are farther apart.
    `pruned`, a list of two numbers, is given the comparisons that boundaries ruled out and those that are left.
    """
    far = distance(fp[own], fp[own[0]]) if len(own) > leaf else np.zeros(0, np.int16)
    at = int(np.median(far)) if len(far) else 0
    near = far <= (at if len(far) and (far > at).any() else at - 1)
    if len(own) <= leaf or min(near.sum(), (~near).sum()) * 16 < len(own):  # few, or members that a boundary doesn't part
        if pruned is not None:
            pruned[1] += len(own) * (len(own) - 1) // 2 + len(own) * len(guests)
        yield own, guests
        return
    edge = int(far[near].max())
    inner, outer, around = own[near], own[~near], distance(fp[guests], fp[own[0]])
    visits = outer[far[~near] <= edge + radius]
    in_guests, out_guests = guests[around <= edge + radius], guests[around > edge - radius]
    if pruned is not None:
        pruned[0] += len(inner) * (len(outer) - len(visits) + len(guests) - len(in_guests)) + len(outer) * (len(guests) - len(out_guests))
    yield from leaves(fp, inner, np.concatenate([in_guests, visits]), radius, leaf, pruned)
    yield from leaves(fp, outer, out_guests, radius, leaf, pruned)


def links(
    fp: np.ndarray, own: np.ndarray, guests: np.ndarray, radius: int = RADIUS, pruned: list[int] | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within `radius` among the members `own`, and between them and `guests`."""
    for a, b in leaves(fp, own, guests, radius, LEAF, pruned):
        yield from _scan(fp, a, b, radius)


class Union:
    """Components of places 0 .. n - 1."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two weren't connected before."""
        x, y = self.find(i), self.find(j)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _scan(fp: np.ndarray, own: np.ndarray, guests: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(own), BLOCK):
        a = own[i : i + BLOCK]
        for j in range(i, len(own), BLOCK):
            b = own[j : j + BLOCK]
            x, y = np.nonzero(distance(fp[a][:, None], fp[b][None]) <= radius)
            keep = x < y if i == j else slice(None)
            yield a[x[keep]], b[y[keep]]
        for j in range(0, len(guests), BLOCK):
            b = guests[j : j + BLOCK]
            x, y = np.nonzero(distance(fp[a][:, None], fp[b][None]) <= radius)
            yield a[x], b[y]


def forest(own: np.ndarray, guests: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints `own` and to `guests`: at most one edge for each of them."""
    nodes = np.concatenate([own, guests])
    union, kept = Union(len(nodes)), []
    for a, b in links(nodes[:, None], np.arange(len(own)), len(own) + np.arange(len(guests)), radius):
        kept += [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if union.join(i, j)]
    both = np.array(kept, np.int64).reshape(-1, 2)
    return nodes[both[:, 0]], nodes[both[:, 1]]


def shard_keys(fp: Column) -> Column:
    """array<long>: the choice of blocks and their bits, mixed into one number each. Unequal contents may share a number; a shard is only where pairs are looked for."""
    parts, at = [], 0
    for w in WIDTHS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    return F.array(*[F.xxhash64(F.lit(i), *[parts[b] for b in blocks]) for i, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, guest, fp) sorted by shard -> edges (u, v); a shard may go on over batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None

    def close() -> pa.RecordBatch | None:
        fp, guest = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        own = np.unique(fp[~guest])
        if len(fp) < 2 or not len(own):
            return None
        u, v = forest(own, np.unique(fp[guest]))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]) if len(u) else None

    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        guest = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        fp = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        edge = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if a == b:
                continue
            if last is not None and shard[a] != last and held:
                if (sum(len(x[0]) for x in held) > 1) and (out := close()) is not None:
                    yield out
                held = []
            held.append((fp[a:b], guest[a:b]))
            last = shard[a]
    if held and sum(len(x[0]) for x in held) > 1 and (out := close()) is not None:
        yield out


def edges(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) over distinct fingerprints (column fp): enough of the links within RADIUS to connect what they connect."""
    rows = distinct.select("fp", F.explode(shard_keys(F.col("fp"))).alias("shard"))
    sizes = cut(rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("fp").alias("_p"), F.max("fp").alias("_q")).where("n > 1"))
    plain = rows.join(sizes.where(F.col("n") <= hot).select("shard"), "shard", "left_semi").select("shard", F.lit(False).alias("guest"), "fp")
    # hot shards: a cell for each pair of distances from two vantage points. A member is at home in one, and visits those that are up to RADIUS
    # below its own from the first point, and as far on either side from the second: a pair meets where the end nearer to the first one is at home
    ring = lambda v: F.bit_count(F.col("fp").bitwiseXOR(F.col(v)))
    homes = rows.join(sizes.where(F.col("n") > hot), "shard").select("fp", "shard", ring("_p").alias("p"), ring("_q").alias("q"))
    cells = homes.withColumn("at_p", F.explode(F.sequence(F.greatest(F.col("p") - RADIUS, F.lit(0)), "p")))
    cells = cells.withColumn("at_q", F.explode(F.sequence(F.col("q") - RADIUS, F.col("q") + RADIUS)))
    rings = cells.select(F.xxhash64("shard", "at_p", "at_q").alias("shard"), (F.col("at_p") != F.col("p")) | (F.col("at_q") != F.col("q")), "fp")
    rings = rings.toDF("shard", "guest", "fp")
    dealt = plain.unionByName(rings).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(by_shard, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reachable over links, itself included."""
    spark = docs.sparkSession
    small_batches(spark)
    checkpoint_dir(spark)
    marked = cut(docs.select(F.col(id_col), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    joined = components(edges(distinct))
    rooted = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
