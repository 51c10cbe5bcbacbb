"""Toxicity: class-conditional Kneser-Ney models over characters.

Texts are read as code points, without case and with all white space alike; every other code point stays distinct. Counts of grams of
ORDER characters by class come from every labelled row outside the held-out folds, as a DataFrame without a ceiling: it grows with the
text. The highest order is discounted per class; all lower orders are Kneser-Ney continuation counts shared by both classes, so that rare
expressions weigh nothing either way. A text's toxic and ordinary log-likelihoods are compared per symbol, over the
whole text and over its most toxic expression, a window of SPAN symbols, and two weights fitted on a separate fold give a probability.

A gram that was never seen backs off to the same lower orders in both classes, which cancel, so that only the weights of its context count.
The model therefore is a table of one number for each gram and each context that was seen. Up to MOST rows, which are counted, it is
broadcast; a larger one is joined with the distinct grams of each bundle of texts.

Nulls and empty texts have no grams: both comparisons are 0. Repeated rows get equal scores. Without labelled rows of
both classes the score is the known share of toxic rows (0.0 if nothing is known). Of an id's conflicting labels the toxic one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import beside, buffers, checkpoint_dir, cut, fit_logistic, fold, runs, small_batches

ORDER, SPAN, DISCOUNT = 5, 12, 0.75
#: A log-likelihood ratio is kept as a byte, in steps of 1 / SCALE, within +-127 / SCALE.
SCALE = 12.0
BLOCK = 1 << 20
#: Rows of a model that is broadcast (about 30 bytes each), labels that are (about 40 bytes each), and bytes of text that share a bundle beyond that.
MOST, MOST_LABELS, BUNDLE = 4_000_000, 1_000_000, 16 << 20
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def case_table() -> np.ndarray:
    """Code point -> symbol: small letters for capitals, a blank for white space and controls, anything else as it is."""
    t = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1F000):
        c = chr(i)
        low = c.lower()
        t[i] = 32 if c.isspace() or i < 32 or i == 127 else ord(low) if len(low) == 1 else i
    return t


_CASE: list[np.ndarray] = []


def symbols(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, each after ORDER - 1 blanks; the first place of the gram that ends at each text's own symbols; their number by text)."""
    if not _CASE:
        _CASE.append(case_table())
    data = raw[offsets[0] : offsets[-1]]
    points = _CASE[0][np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    size = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets - offsets[0]])
    place = np.arange(len(points)) + np.repeat(np.arange(len(size)) * (ORDER - 1), size)
    sym = np.full(len(points) + (ORDER - 1) * len(size), 32, np.uint32)
    sym[place + (ORDER - 1)] = points
    return sym, place, size


def hashes(sym: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` symbols that end at each place from size - 1 on."""
    one = (sym.astype(np.uint64) + np.uint64(1)) * ODD
    one = (one ^ (one >> np.uint64(31))) * MIX
    out = one[size - 1 :].copy()
    for k in range(1, size):
        out += one[size - 1 - k : len(one) - k] * np.uint64(pow(int(ODD), k, 1 << 64))
    return (out ^ (out >> np.uint64(29))) * MIX


@dataclass
class Model:
    """The ratios of grams and contexts, found by hash."""

    keys: np.ndarray  # uint64, by slot
    values: np.ndarray  # int8
    first: np.ndarray  # where each slot begins
    most: int

    @classmethod
    def of(cls, grams: list[str], values: np.ndarray) -> Model:
        h, sizes = np.zeros(len(grams), np.uint64), np.array([len(g) for g in grams], np.int64)
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            sym = np.frombuffer("".join(grams[i] for i in at.tolist()).encode("utf-32-le"), np.uint32)
            h[at] = hashes(sym, n)[::n]
        bits = max(4, int(2 * max(1, len(grams))).bit_length())
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        most = int(np.bincount(slot).max()) if len(h) else 0
        pad = np.zeros(most, np.uint64)
        return cls(
            np.append(h[order], pad), np.append(np.asarray(values, np.int8)[order], pad.astype(np.int8)),
            np.searchsorted(slot[order], np.arange((1 << bits) + 1)).astype(np.int32), most,
        )

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether it is known) of each hash."""
        slot = (h >> np.uint64(64 - (len(self.first) - 1).bit_length() + 1)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        value, known = np.zeros(len(h), np.int8), np.zeros(len(h), bool)
        todo = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.keys[at[todo]] == h[todo]
            value[todo[hit]], known[todo[hit]] = self.values[at[todo[hit]]], True
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
            if not len(todo):
                break
        return value, known

    def compare(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """(mean ratio, ratio of the most toxic window) for each document."""
        out = np.zeros((len(offsets) - 1, 2))
        for i, j in runs(offsets, BLOCK):
            if offsets[i] < offsets[j]:
                out[i:j] = self._compare(offsets[i : j + 1], raw)
        return out

    def _compare(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        sym, place, size = symbols(offsets, raw)
        own, known = self.look(hashes(sym, ORDER)[place])
        missing = np.flatnonzero(~known)
        own[missing] = self.look(hashes(sym, ORDER - 1)[place[missing]])[0]
        inside = np.repeat(np.arange(len(size)), size)
        total = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        off = np.concatenate([[0], np.cumsum(size)])
        sums = total[off[1:]] - total[off[:-1]]
        best = sums.copy()
        if len(total) > SPAN:
            window = np.append(total[SPAN:] - total[:-SPAN], np.full(SPAN, np.iinfo(np.int64).min))
            fits = np.arange(len(window)) + SPAN <= np.append(off[1:][inside], np.zeros(len(window) - len(inside), np.int64))
            window[~fits] = np.iinfo(np.int64).min
            full = np.flatnonzero(size > 0)
            most = np.maximum.reduceat(window, off[:-1][full])
            best[full] = np.where(size[full] >= SPAN, most, best[full])
        return np.column_stack([sums / np.maximum(size, 1), best / SPAN]) / SCALE


def count(labelled: DataFrame, label: str = "_label", text_col: str = "text") -> DataFrame:
    """(gram, ordinary, toxic) over all rows: counted by batch on the executors, then summed by gram."""

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(0))
            is_toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)) == 1
            for i, j in runs(offsets, BLOCK * 4):
                if offsets[i] == offsets[j]:
                    continue
                sym, place, size = symbols(offsets[i : j + 1], raw)
                _, at, inverse = np.unique(hashes(sym, ORDER)[place], return_index=True, return_inverse=True)
                n, t = np.bincount(inverse), np.bincount(inverse, weights=np.repeat(is_toxic[i:j], size)).astype(np.int64)
                grams = np.ascontiguousarray(sym[place[at][:, None] + np.arange(ORDER)]).view(f"<U{ORDER}")[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n - t), pa.array(t)], ["gram", "ordinary", "toxic"])

    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")), label).mapInArrow(by_batch, "gram string, ordinary long, toxic long")
    return rows.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def tail(gram: Column, size: int) -> Column:
    return F.substring(gram, -size, size) if size else F.lit("")


def shared(counts: DataFrame) -> DataFrame:
    """(gram, p) for grams of ORDER - 1 characters: Kneser-Ney probabilities from continuation counts of both classes together."""
    orders = [counts.select("gram")]
    for size in range(ORDER - 1, 0, -1):
        orders.append(cut(orders[-1].groupBy(tail(F.col("gram"), size).alias("gram")).agg(F.count("*").alias("n"))))
    lower = None
    for size, now in zip(range(1, ORDER), reversed(orders[1:]), strict=True):
        group = Window.partitionBy(F.substring("gram", 1, size - 1))
        total, types = F.sum("n").over(group), F.count("*").over(group)
        rows = now.select(
            "gram", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / total).alias("own"), (DISCOUNT * types / total).alias("back"),
            (1.0 / (types + 1)).alias("even"),
        )
        if lower is None:
            lower = rows.select("gram", (F.col("own") + F.col("back") * F.col("even")).alias("p"))
        else:
            lower = rows.join(
                lower.withColumnRenamed("gram", "_tail"), tail(F.col("gram"), size - 1) == F.col("_tail"),
            ).select("gram", (F.col("own") + F.col("back") * F.col("p")).alias("p"))
    return lower


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, value) of the model: the ratio of each gram that was seen, and the ratio of backoff weights of each context."""
    group = Window.partitionBy("context")
    rows = counts.withColumn("context", F.substring("gram", 1, ORDER - 1))
    stats = [e.over(group).alias(f"{name}_{c}") for c in ("ordinary", "toxic") for name, e in (("total", F.sum(c)), ("types", F.count_if(F.col(c) > 0)))]
    rows = rows.select("gram", "context", "ordinary", "toxic", *stats)
    back = lambda c: F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.greatest(F.col(f"total_{c}"), F.lit(1))).otherwise(1.0)
    rows = rows.select("*", back("ordinary").alias("back_ordinary"), back("toxic").alias("back_toxic"))
    rows = cut(rows.join(shared(counts).withColumnRenamed("gram", "_tail"), tail(F.col("gram"), ORDER - 1) == F.col("_tail")))
    p = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"total_{c}"), F.lit(1)) + F.col(f"back_{c}") * F.col("p")
    byte = lambda x: F.greatest(F.least(F.round(x * SCALE), F.lit(127.0)), F.lit(-127.0)).cast("tinyint").alias("value")
    seen = rows.select("gram", byte(F.ln(p("toxic")) - F.ln(p("ordinary"))))
    contexts = rows.groupBy("context").agg(F.first("back_toxic").alias("t"), F.first("back_ordinary").alias("o"))
    return seen.unionByName(contexts.select(F.col("context").alias("gram"), byte(F.ln("t") - F.ln("o"))))


def known_labels(labels: DataFrame, label: str, where: Column, id_col: str) -> DataFrame:
    return labels.where(where & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("_label"))


def model_of(docs: DataFrame, labels: DataFrame, label: str, where: Column, id_col: str, text_col: str) -> DataFrame | None:
    """(gram, value) from the labelled rows that `where` leaves, checkpointed; None without both classes."""
    known = cut(known_labels(labels, label, where, id_col))
    counts = cut(count(beside(docs.select(id_col, text_col), known, [id_col], "inner", most=MOST_LABELS), "_label", text_col))
    both = counts.agg(F.sum("ordinary"), F.sum("toxic")).first()
    return cut(ratios(counts)) if both[0] and both[1] else None


def features(docs: DataFrame, model: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """`docs` with (mean, best) added and without the text."""
    names = [c for c in docs.columns if c != text_col]
    if model.count() > most:
        return joined_features(docs, model, names, text_col)
    table = model.toArrow()
    own = docs.sparkSession.sparkContext.broadcast(Model.of(table.column(0).to_pylist(), table.column(1).to_numpy()))

    @F.arrow_udf("struct<mean:double,best:double>")
    def compare(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = own.value.compare(*buffers(texts))
            yield pa.StructArray.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["mean", "best"])

    return docs.select(*names, compare(F.col(text_col)).alias("_c")).select(*names, "_c.mean", "_c.best")


def joined_features(docs: DataFrame, model: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """The same by a join: texts are dealt into bundles, and each bundle gets the model's rows for the grams that it holds.

    A task reads a bundle's part of the model first, at most a gram and a context for each symbol, and then its texts.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bundles = F.lit(max(1, size // BUNDLE))
    dealt = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt = dealt.withColumn("_bundle", F.pmod(F.xxhash64("_text", F.to_json("_row")), bundles))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            bundle = batch.column(0).to_numpy()
            for i, j in runs(offsets, BLOCK):
                if offsets[i] == offsets[j]:
                    continue
                sym, place, length = symbols(offsets[i : j + 1], raw)
                owner = np.repeat(bundle[i:j], length)
                _, at = np.unique(np.column_stack([hashes(sym, ORDER)[place], owner.astype(np.uint64)]), axis=0, return_index=True)
                grams = np.ascontiguousarray(sym[place[at][:, None] + np.arange(ORDER)]).view(f"<U{ORDER}")[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(grams, pa.string())], ["_bundle", "gram"])

    asked = dealt.select("_bundle", "_text").mapInArrow(ask, "_bundle long, gram string").distinct()
    asked = asked.unionByName(asked.select("_bundle", F.substring("gram", 1, ORDER - 1).alias("gram")).distinct())
    answers = asked.join(model, "gram").select(
        "_bundle", F.lit(0).alias("_kind"), F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"), F.col("gram").alias("_text"), "value",
    )
    rows = answers.unionByName(dealt.select("_bundle", F.lit(1).alias("_kind"), "_row", "_text", F.lit(None).cast("tinyint").alias("value")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, values, own = None, [], [], None
        for batch in batches:
            bundle, kind = batch.column("_bundle").to_numpy(), batch.column("_kind").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero((np.diff(bundle) != 0) | (np.diff(kind) != 0)) + 1, [len(bundle)]])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if i == j:
                    continue
                if bundle[i] != now:
                    now, grams, values, own = bundle[i], [], [], None
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    grams += part.column("_text").to_pylist()
                    values.append(part.column("value").to_numpy(zero_copy_only=False))
                    continue
                own = own or Model.of(grams, np.concatenate(values) if values else np.zeros(0, np.int8))
                got = own.compare(*buffers(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(got[:, 0]), pa.array(got[:, 1])], ["_row", "mean", "best"])

    kind_of = dealt.schema["_row"].dataType.simpleString()
    got = rows.repartition("_bundle").sortWithinPartitions("_bundle", "_kind").mapInArrow(compare, f"_row {kind_of}, mean double, best double")
    return got.select("_row.*", "mean", "best")


def fit_weights(
    docs: DataFrame, labels: DataFrame, model: DataFrame, prior: float, label: str, where: Column, tune_rows: int, id_col: str, text_col: str,
) -> np.ndarray:
    """Weights of the mean, of the best window and of 1, from at most `tune_rows` texts of each class by a hash of the id."""
    spark = docs.sparkSession
    known = known_labels(labels, label, where, id_col)
    ids = [tuple(r) for c in (0, 1) for r in known.where(F.col("_label") == c).orderBy(F.xxhash64(F.lit(13), F.col(id_col)), id_col).limit(tune_rows).collect()]
    odds = np.log(prior / (1 - prior))
    got = []
    if ids:
        some = docs.select(id_col, text_col).join(F.broadcast(spark.createDataFrame(ids, known.schema)), id_col)
        got = features(some, model, text_col).select("mean", "best", "_label").collect()
    y = np.array([r[2] for r in got], float)
    if not len(y) or y.min() == y.max():
        return np.array([4.0, 4.0, odds - 1])
    x = np.array([[r[0], r[1]] for r in got])
    order = np.lexsort((x[:, 1], x[:, 0], y))
    w = fit_logistic(x[order] * 10, y[order], l2=1e-4)
    return np.array([w[0] * 10, w[1] * 10, w[2] + odds - np.log(y.mean() / (1 - y.mean()))])


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", folds: int = 5, held: int = 0, tune: int = 1,
    tune_rows: int = 600, id_col: str = "doc_id", text_col: str = "text", most: int = MOST,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row. Counts come from every labelled row outside the folds `held` and `tune`."""
    small_batches(docs.sparkSession)
    checkpoint_dir(docs.sparkSession)
    part = fold(id_col, folds)
    share = known_labels(labels, label, part != held, id_col).agg(F.avg("_label")).first()[0] or 0.0
    prior = min(max(share, 1e-6), 1 - 1e-6)
    model = model_of(docs, labels, label, (part != held) & (part != tune), id_col, text_col)
    some = docs.select(id_col, text_col)
    if model is None:
        scored = some.select(id_col, F.lit(0.0).alias("mean"), F.lit(0.0).alias("best"))
        weights = np.array([0.0, 0.0, np.log(prior / (1 - prior))])
    else:
        weights = fit_weights(docs, labels, model, prior, label, part == tune, tune_rows, id_col, text_col)
        scored = features(some, model, text_col, most)
    z = F.col("mean") * float(weights[0]) + F.col("best") * float(weights[1]) + float(weights[2])
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return scored.select(id_col, (part == held).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
