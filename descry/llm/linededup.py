"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

A line with a letter or digit is dropped if the same line stands earlier (in the same document, or in one with a smaller id); one of
at least MIN_CHARS characters also if an earlier line is within EDITS edits of it. Of a set of linked lines the earliest always stays.

Two lines within EDITS edits share at least one of EDITS + 1 segments of the shorter one, shifted by a bounded offset. So each
line is indexed under its segments, and probes those of lines as long or up to EDITS shorter at every offset that the
lengths leave open (7 or 8 keys a line for two edits). Only keys under which an indexed line meets a different one are looked at again; their
lines are compared by a banded bit-parallel edit distance in a semi join, whose output stays linear in the number of lines.

Hot keys and lines: keys that are frequent in a sample of documents (a common beginning of many lines) are no place to compare lines.
Lines that share such a segment within EDITS edits are also within EDITS edits without it, so they share a segment of the rest as well,
and meet under both, up to LEVELS times. Lines that make up a ten-thousandth of all lines or more take part once. Both decide the cost, never the result.

Documents that share an id count as one document; ids are of any type that has an order. Nulls stay null and have no lines; blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import beside, checkpoint_dir, cut

EDITS, MIN_CHARS, LEVELS = 2, 20, 3
#: About so many documents are looked at for hot keys, which are in OFTEN of their lines at least, and at most MOST_HOT keys.
SAMPLE, OFTEN, MOST_HOT = 4000, 20, 100_000
#: A line is heavy if it is so large a share of all repeated lines; there are at most 1 / HEAVY of them.
HEAVY = 1e-4
#: Letters whose numbers are compared before the lines are: an edit changes them by two at most, together.
LETTERS = ["e", "t", "a", "o", "i", "n", "s", "hr"]
WORD = r"[\p{L}\p{N}]"


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spots(rest: int, edits: int) -> list[tuple[int, int, int, bool]]:
    """(part, begin, width, index) of the windows of a line of parts * k + rest characters; begin counts from k * part, width from k.

    A window is an own segment (index) or a segment, shifted by as much as the lengths leave open, of a line up to `edits` shorter. Several
    lengths can ask for one window: the length isn't part of the key, so that it is looked up once, and candidates' lengths are compared later.
    """
    parts, k, out = edits + 1, 1 << 20, {}
    for less in range(parts):
        base, more = divmod(k * parts + rest - less, parts)
        for i in range(parts):
            # the last `more` segments have one character more
            begin, width = base * i + max(more - (parts - i), 0), base + (i >= parts - more)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                window = i, begin + shift - k * i, width - k
                out[window] = out.get(window, False) or (less == 0 and shift == 0)
    return [(*window, index) for window, index in out.items()]


def keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """`lines` (line, size, ...) with (key, index, rest): a row for each window that is a segment (index) or a probe; rest is the line without it.

    The places are short literal arrays that are exploded, so that one small expression makes all keys. A window that leaves the line is no probe.
    """
    parts = edits + 1
    k, more = F.call_function("div", F.col("size"), F.lit(parts)).cast("int"), F.col("size") % parts
    names = ("part", "_from", "_more", "index")
    places = [F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(spot, names, strict=True)]) for spot in spots(r, edits)]) for r in range(parts)]
    chosen = places[0]
    for r in range(1, parts):
        chosen = F.when(more == r, places[r]).otherwise(chosen)
    rows = lines.select("*", k.alias("_k"), F.inline(chosen))
    rows = rows.withColumns({"_begin": F.col("_k") * F.col("part") + F.col("_from"), "_width": F.col("_k") + F.col("_more")})
    rows = rows.where((F.col("_begin") >= 0) & (F.col("_begin") + F.col("_width") <= F.col("size")))
    key = F.xxhash64("part", F.substring(F.col("line"), F.col("_begin") + 1, F.col("_width")))
    rest = F.concat(F.substring(F.col("line"), F.lit(1), F.col("_begin")), F.substring(F.col("line"), F.col("_begin") + F.col("_width") + 1, F.col("size")))
    return rows.withColumns({"key": key, "rest": rest}).drop("part", "_k", "_from", "_more", "_begin", "_width")


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two arrays of code points, of lengths at most `edits` apart and at least `edits` long, are within `edits` edits.

    The band of 2 x edits + 1 diagonals is one word, which moves down the diagonal with each character of `b`: bit k is row
    j - edits + k of the column for character j. VP and VN are its vertical differences. The value at the band's lower edge is followed
    down the diagonal and, once it meets the last row, along that row.
    """
    top = 2 * edits
    full = (1 << (top + 1)) - 1
    m, n = F.size(a), F.size(b)

    def bit(word: Column, at: Column) -> Column:
        return F.call_function("shiftright", word, at).bitwiseAND(F.lit(1))

    def step(s: Column, j: Column) -> Column:
        match = F.lit(0)
        for k in range(top + 1):
            match = match + F.when(F.get(a, j + (k - edits)) == F.get(b, j), 1 << k).otherwise(0)

        def with_match(x: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def with_d0(d: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(F.lit(full))
                hn = d.bitwiseAND(vp)
                down = F.lit(1) - F.shiftright(d, top)
                last = m - 1 - j + edits
                value = s["d"] + F.when(j < m - edits, down).otherwise(bit(hp, last) - bit(hn, last))
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(F.shiftright(d, 1).bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"),
                    F.shiftright(d, 1).bitwiseAND(hp).alias("vn"), value.alias("d"),
                )

            return let(d0, with_d0)

        return F.when(s["d"] > 2 * edits + n - m, s).otherwise(let(match, with_match))

    start = F.struct(F.lit(full - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["d"] <= edits


def shared_beginning(a: Column, b: Column) -> Column:
    """The length of the longest common beginning of two texts, by halves."""
    n = F.least(F.char_length(a), F.char_length(b))
    steps = F.sequence(F.ceil(F.log2(n + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))

    def grow(done: Column, step: Column) -> Column:
        more = F.call_function("shiftleft", F.lit(1), step)
        return F.when((done + more <= n) & (F.substring(a, done + 1, more) == F.substring(b, done + 1, more)), done + more).otherwise(done)

    return F.aggregate(steps, F.lit(0), grow)


def near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """within() of two texts, without what they share at either end (but for `edits` characters): it costs no edit."""
    short = F.char_length(a)

    def without_beginning(same: Column) -> Column:
        cut_off = lambda x: F.reverse(F.substring(x, F.least(same, short - edits) + 1, F.char_length(x)))
        return let(F.struct(cut_off(a).alias("a"), cut_off(b).alias("b")), without_end)

    def without_end(rest: Column) -> Column:
        same = F.least(shared_beginning(rest["a"], rest["b"]), F.char_length(rest["a"]) - edits)
        chars = lambda x, n: F.transform(F.split(F.substring(x, n + 1, F.char_length(x)), ""), lambda c: F.ascii(c))
        return let(same, lambda n: let(F.struct(chars(rest["a"], n).alias("a"), chars(rest["b"], n).alias("b")), lambda m: within(m["a"], m["b"], edits)))

    return let(shared_beginning(a, b), without_beginning)


def tagged(text: Column) -> Column:
    """The lines, blank ones marked by their place so that they all differ, others each once."""
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(WORD), x).otherwise(F.concat(i.cast("string"), F.lit("\n"), x))))


def untagged(line: Column) -> Column:
    return F.when(line.contains("\n"), F.substring_index(line, "\n", -1)).otherwise(line)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, i, line, h, h2): distinct lines of each text; t tells texts apart, (h, h2) lines."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.posexplode(tagged(F.col(text_col))).alias("i", "line"),
    ).where(~F.col("line").contains("\n"))
    return rows.select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def frequent(keyed: DataFrame) -> DataFrame:
    """(key, n): those in at least OFTEN rows of a sample's keys, or in a share of them that at most MOST_HOT keys can have."""
    keyed = cut(keyed.groupBy("key").agg(F.count("*").alias("n")))
    least = max(OFTEN, -(-(keyed.agg(F.sum("n")).first()[0] or 0) // MOST_HOT))
    return keyed.where(F.col("n") >= least).select("key")


def met(lines: DataFrame, sample: DataFrame, edits: int, level: int = 1) -> DataFrame:
    """(key, h, index): the lines (line, size, h, on) under each key where an indexed one meets a different one.

    `sample` holds lines of the same kind in which frequent keys are looked for; `on` is what the lines share already.
    """

    def keyed(some: DataFrame) -> DataFrame:
        rows = keys(some, edits)
        return rows.withColumn("key", F.xxhash64("on", "key")).withColumn("index", F.col("index") & F.col("indexed")) if level > 1 else rows

    rows, hot = keyed(lines), None
    if level < LEVELS:
        hot = cut(frequent(keyed(sample)))
        if hot.isEmpty():
            hot = None
    plain = rows if hot is None else rows.join(F.broadcast(hot), "key", "left_anti")
    dealt = plain.select("key", "h", "index").repartition("key")
    shared = dealt.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("index").alias("any")).where("a <> b and any").select("key")
    # the filter, which is always true, keeps the exchange as it is, so that the join reads the one of the aggregation again
    out = dealt.where(F.spark_partition_id() >= 0).join(shared.hint("shuffle_hash"), "key", "left_semi")
    if hot is None:
        return out
    without = lambda some: keyed(some).join(F.broadcast(hot), "key").select(
        "h", F.col("rest").alias("line"), F.char_length("rest").alias("size"), F.col("key").alias("on"), F.col("index").alias("indexed"),
    )
    return out.unionByName(met(without(lines), without(sample), edits, level + 1))


def near_lines(lines: DataFrame, sample: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h, h2) of the lines with an earlier different line within `edits` edits. `lines`: id, i, line, h, h2, each line once for a document."""
    own = lambda some: some.select("line", F.char_length("line").alias("size"), "h")
    found = cut(met(own(lines), own(sample), edits))
    wanted = cut(found.select("h").distinct())
    counts = [(F.char_length("line") - F.char_length(F.translate("line", x, ""))).alias(f"c{k}") for k, x in enumerate(LETTERS)]
    texts = beside(lines, wanted, ["h"], "left_semi").groupBy("h", "h2").agg(F.min(F.struct("id", "i", "h", "h2")).alias("at"), F.first("line").alias("line"))
    texts = cut(texts.select("h", "h2", "at", "line", F.char_length("line").alias("size"), *counts))
    rows = found.join(texts.select("h", "at", "size", *[f"c{k}" for k in range(len(LETTERS))]), "h")
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.lit(0)
    for k in range(len(LETTERS)):
        apart = apart + F.abs(F.col(f"a.c{k}") - F.col(f"b.c{k}"))
    # one of the two stands under the key as indexed, the longer one (or an equally long one) as probing
    gap = F.col("a.size") - F.col("b.size")
    alike = (F.col("a.key") == F.col("b.key")) & (F.col("a.at") != F.col("b.at")) & (apart <= 2 * edits)
    probe = a.join(b.where("b.index"), alike & gap.between(0, edits), "left_semi")
    index = a.where("a.index").join(b, alike & (-gap).between(0, edits), "left_semi")
    left = cut(probe.unionByName(index).select("key", "index", "at").distinct())
    full = cut(left.join(texts.select("at", "h", "h2", "size", "line"), "at"))
    a, b = full.alias("a"), full.alias("b")
    # b is the earlier line
    other = (F.col("a.key") == F.col("b.key")) & (F.col("b.at") < F.col("a.at"))
    gap = F.col("a.size") - F.col("b.size")
    late_probe = a.join(b.where("b.index"), other & gap.between(0, edits) & near(F.col("b.line"), F.col("a.line"), edits), "left_semi")
    late_index = a.where("a.index").join(b, other & (-gap).between(0, edits) & near(F.col("a.line"), F.col("b.line"), edits), "left_semi")
    return late_probe.select("h", "h2").unionByName(late_index.select("h", "h2")).distinct()


def decide(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, gone, n_same, n_near): places of the dropped ones among a text's tagged lines, for the texts that lose any to another line."""
    checkpoint_dir(docs.sparkSession)
    lines = lines_of(docs, id_col, text_col)
    repeated = cut(lines.groupBy("h", "h2").agg(F.min("id").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    every = max(1, docs.count() // SAMPLE)
    all_repeated = repeated.agg(F.sum("n")).first()[0] or 0
    heavy = repeated.where(F.col("n") >= F.lit(HEAVY * all_repeated)).select("h", "h2", F.col("owner").alias("_first"))
    once = lines.where(F.char_length("line") >= min_chars).join(F.broadcast(heavy), ["h", "h2"], "left").where(F.col("_first").isNull() | F.col("id").eqNullSafe(F.col("_first"))).drop("_first")
    few = F.pmod(F.xxhash64(F.lit(7), F.col(id_col), F.xxhash64(text_col)), F.lit(every)) == 0
    sample = lines_of(docs.where(few), id_col, text_col).where(F.char_length("line") >= min_chars).dropDuplicates(["h", "h2"])
    near = near_lines(once, sample, edits).select("h", "h2", F.lit(None).cast(repeated.schema["owner"].dataType).alias("owner"), F.lit(True).alias("near"))
    same_lines = repeated.select("h", "h2", "owner", F.lit(False).alias("near"))
    marks = cut(same_lines.unionByName(near).groupBy("h", "h2").agg(F.max("owner").alias("owner"), F.max("near").alias("near")))
    salts = 8
    n = marks.count()
    if n > 250_000:  # beyond that, a line with a third of all rows is joined in `salts` places
        marks = marks.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    rows = lines.select("id", "t", "i", "h", "h2", F.pmod(F.xxhash64("id", "t"), F.lit(salts)).cast("int").alias("salt"))
    found = beside(rows, marks, ["h", "h2"] + ["salt"] * (n > 250_000), "inner", n)
    same = F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    found = found.select("id", "t", "i", F.col("near"), same.alias("same")).where("near or same")
    return found.groupBy("id", "t").agg(
        F.collect_set("i").alias("gone"), F.count_if("same").alias("n_same"), F.count_if(F.col("near") & ~F.col("same")).alias("n_near"),
    )


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, lines, n_lines, n_same, n_near): a row of `docs` as a struct, its kept lines, and numbers."""
    gone = decide(docs, edits, min_chars, id_col, text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    both = rows.join(gone, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("t")), "left")

    def kept(all_lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.coalesce("gone", F.array().cast("array<int>")))
        return F.transform(places, lambda i: untagged(F.get(all_lines, i)))

    return both.select(
        "row", let(tagged(text), kept).alias("lines"), F.size(F.split(text, "\n")).alias("n_lines"), F.coalesce("n_same", F.lit(0)).alias("n_same"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_kept, n_same, n_near, kept_sha256) for every row; n_same and n_near count distinct lines that an earlier document's line displaced."""
    done = deduplicate(docs.select(id_col, text_col), edits, min_chars, id_col, text_col)
    empty = F.col("row")[text_col].isNull()
    n = lambda x: F.when(empty, 0).otherwise(x).cast("long")
    return done.select(
        F.col("row")[id_col].alias(id_col), n(F.col("n_lines")).alias("n_lines"), n(F.size("lines")).alias("n_kept"), "n_same", "n_near",
        F.sha2(F.coalesce(F.array_join("lines", "\n"), F.lit("")), 256).alias("kept_sha256"),
    )


def rewrite(
    docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars",
) -> DataFrame:
    """`docs` with the kept lines as text. A document that loses every line, all of which stand elsewhere, goes; one without any text stays as it is."""
    old = F.col("row")[text_col]
    done = deduplicate(docs, edits, min_chars, id_col, text_col).where(old.isNull() | (F.size("lines") > 0))
    text = F.when(old.isNotNull(), F.array_join("lines", "\n"))
    new = {text_col: text} | ({size_col: F.char_length(text).cast(docs.schema[size_col].dataType)} if size_col and size_col in docs.columns else {})
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
