"""Order MinHash fingerprints, with DataFrame functions only.

Tokens are runs of non-space characters, at most TOKEN long; k-mers are K tokens in a row (fewer tokens: the whole
sequence). The i-th repeat of a k-mer in a text counts as a k-mer of its own. They are hashed with ORDERS seeds and sorted by each;
each of M sketches is one of these orders from its own start on (around the end), and takes the L = 2 minimal ones. The two are put
back into text order and hashed as a tuple, of which 16 bits are kept. So a sketch agrees only if both the k-mers and
their order do, and the share of agreeing sketches follows the edit distance more closely than a set's likeness.
Sketches of one order from near starts depend on each other where a text has few k-mers; README has the spread that is left.

Nulls count as empty; a text without tokens has the fingerprint of no k-mers. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN, K, M, ORDERS = 16, 2, 64, 4
#: The low bits of a packed long are a k-mer's place in the text, the high ones its hash. 2**28 tokens are more than a text of half a GB can have.
PLACE = 28
#: Rows of a range of ids.
RANGE = 50_000
MASK = (1 << PLACE) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack(high: Column, low: Column) -> Column:
    return high.bitwiseAND(F.lit(~MASK)).bitwiseOR(low.cast("long").bitwiseAND(F.lit(MASK)))


def power(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), b)


def kmers(tokens: Column) -> Column:
    """Sorted packed hashes of the k-mers of an array of token hashes."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(0), n - K), lambda i: pack(F.xxhash64(*[F.get(tokens, i + j) for j in range(K)]), i))
    return F.sort_array(F.when(n >= K, many).when(n > 0, F.array(pack(F.xxhash64(tokens), F.lit(0)))).otherwise(F.array().cast("array<bigint>")))


def numbered(packed: Column) -> Column:
    """Sorted hashes of (k-mer, how many times it came before)."""

    def same(a: Column, b: Column) -> Column:
        return F.shiftright(a, PLACE) == F.shiftright(b, PLACE)

    def before(x: Column, j: Column) -> Column:
        """Equal k-mers that stand before place j of the sorted array: a search by halves, only where there are any."""
        steps = F.sequence(F.ceil(F.log2(F.size(packed) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))
        grow = lambda acc, b: F.when(
            (j - acc - power(b) >= 0) & same(F.get(packed, F.greatest(j - acc - power(b), F.lit(0))), x), acc + power(b),
        ).otherwise(acc)
        return F.when((j > 0) & same(F.get(packed, F.greatest(j - 1, F.lit(0))), x), F.aggregate(steps, F.lit(0), grow)).otherwise(F.lit(0))

    return F.sort_array(F.transform(packed, lambda x, j: pack(F.xxhash64(F.shiftright(x, PLACE), before(x, j)), x)))


def signature(ranked: Column) -> Column:
    """The M sketches as hexadecimal digits, four each, of the numbered k-mers."""

    def in_order(seed: int) -> Column:
        again = F.sort_array(F.transform(ranked, lambda x: pack(F.xxhash64(F.lit(seed), F.shiftright(x, PLACE)), x)))
        return let(again if seed else ranked, sketches)

    return F.when(F.size(ranked) > 0, F.concat(*[in_order(seed) for seed in range(ORDERS)])).otherwise(F.repeat(F.lit("0000"), M))


def sketches(ranked: Column) -> Column:
    """The M / ORDERS sketches of one order."""
    n = F.size(ranked)
    steps = F.sequence(F.ceil(F.log2(n + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))

    def sketch(start: Column) -> Column:
        first = F.aggregate(
            steps, F.lit(0), lambda acc,
            b: F.when((acc + power(b) <= n) & (F.get(ranked, F.least(acc + power(b), n) - 1) < start), acc + power(b)).otherwise(acc),
        )
        pair = let(first, lambda i: F.struct(F.get(ranked, F.pmod(i, n)).alias("a"), F.get(ranked, F.pmod(i + 1, n)).alias("b")))

        def tuple_of(p: Column) -> Column:
            a, b = F.shiftright(p["a"], PLACE), F.shiftright(p["b"], PLACE)
            in_order = p["a"].bitwiseAND(F.lit(MASK)) <= p["b"].bitwiseAND(F.lit(MASK))
            return F.when(in_order, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))

        return F.lpad(F.lower(F.hex(let(pair, tuple_of).bitwiseAND(F.lit(0xFFFF)))), 4, "0")

    starts = [s * ((1 << 64) // (M // ORDERS)) - (1 << 63) for s in range(M // ORDERS)]
    return F.array_join(F.transform(F.array(*[F.lit(s).cast("long") for s in starts]), sketch), "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of each whole text."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,%d}" % TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return let(let(let(tokens, kmers), numbered), signature)


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches that agree, 0 to 1."""
    return F.size(
        F.filter(F.sequence(F.lit(0), F.lit(M - 1)), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    ) / F.lit(float(M))


def with_next(docs: DataFrame, id_col: str, text_col: str, make: Callable[[Column], Column]) -> DataFrame:
    """(id, text, made, next_text, next_made): each row beside the next one by descending id, the last beside the first.

    Ids are dealt over ranges between quantiles, several for each shuffle partition and one for RANGE rows at least; the texts are shuffled
    once, by range. The first row of the next range comes from a table with a row for each range. Rows with equal ids follow each other by their texts;
    null ids come last.
    """
    spark = docs.sparkSession
    ranges = max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE)
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    bounds = ids.agg(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    edges, many = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(many.bit_length()))]).cast("array<int>")
    found = lambda acc, step: F.when(
        (acc + step <= many) & (F.get(edges, F.least(acc + step, F.lit(max(many, 1))) - 1) <= F.col("_id")), acc + step,
    ).otherwise(acc)
    zone = (-F.aggregate(steps, F.lit(0), found)).alias("_zone")  # how many bounds the id reaches, by halves; ascending zones hold descending ids
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).select("_id", "_text", F.when(F.col("_id").isNull(), 1).otherwise(zone).alias("_zone"))
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("_text"), F.col("_text")]
    tops = base.select("_zone", "_id").groupBy("_zone").agg(F.max("_id").alias("_id")).collect()
    tops_df = spark.createDataFrame([(z, i) for z, i in tops], "_zone int, _top long")
    heads = base.join(F.broadcast(tops_df), "_zone").where(F.col("_id").eqNullSafe(F.col("_top"))).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_zone").orderBy(*order[1:])),
    ).where("_nth = 1")
    zones = sorted(z for z, _ in tops)
    follows = {z: zones[(i + 1) % len(zones)] for i, z in enumerate(zones)}
    after = spark.createDataFrame([(b, a) for a, b in follows.items()] or [(0, 0)], "_zone int, _before int")
    heads = heads.join(F.broadcast(after), "_zone").select(
        F.col("_before").alias("_zone"), F.col("_text").alias("_head"), make(F.col("_text")).alias("_head_made"),
    )
    dealt = base.repartition("_zone").withColumn("_made", make(F.col("_text")))
    row = Window.partitionBy("_zone").orderBy(*order)
    beside = dealt.select("*", F.lead("_text").over(row).alias("_next"), F.lead("_made").over(row).alias("_next_made"))
    return beside.join(heads.hint("merge"), "_zone", "left").select(
        "_id", "_text", "_made", F.coalesce("_next", "_head").alias("_next"), F.coalesce("_next_made", "_head_made").alias("_next_made"),
    )


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row; the ids must be whole numbers.

    The edited text has its last half replaced by as many characters of the next text by descending id.
    """
    pairs = with_next(docs, id_col, text_col, fingerprint)
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    made = let(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), fingerprint(t).alias("fp")))
    out = pairs.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), "_made", "_next_made",
        let(made, lambda e: F.struct(e["sha"].alias("sha"), e["fp"].alias("fp"))).alias("_e"),
    )
    return out.select(
        id_col, "n_chars", F.col("_e.sha").alias("edited_sha256"), F.col("_made").alias("fingerprint"), F.col("_e.fp").alias("edited_fingerprint"),
        likeness(F.col("_made"), F.col("_e.fp")).alias("near_edited"), likeness(F.col("_made"), F.col("_next_made")).alias("near_next"),
    )
