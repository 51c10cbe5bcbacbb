"""Language identification by compression with zstandard raw-content dictionaries, one for each language.

Each whole text is lower-cased and cut into pieces of PIECE bytes (so that a long text keeps leaning on the dictionary and not on
itself), every piece is compressed with each language's dictionary, and the language with the smallest sum wins.
The margin is the relative gap to the second smallest; `rejected` marks narrow ones for callers that want them apart.

Null texts and texts without a letter are UNKNOWN with score 0. Ties go to the language with more known texts.
Without any known language, every text is UNKNOWN. Repeated rows get equal answers. Every language that has one text with a letter
outside the held-out fold is learned, however short or long its texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry.llm.common import fold, small_batches

UNKNOWN, PIECE, LEVEL = "und", 2048, 6
#: Bytes of a dictionary, and texts of a language (by a hash of the id) that may go into it.
CONTENT, CANDIDATES = 110 << 10, 4096


class Dictionaries:
    """A coder for each language."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.names = list(content)
        self.coders = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(content[name].rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)  # fewer than 8 bytes are no dictionary
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False))

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes under each dictionary; the small cost of a frame is equal for all."""
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] if len(text) > PIECE else [text]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]


LETTER = regex.compile(r"\p{L}")


def has_letter(text: str) -> bool:
    return LETTER.search(text) is not None


def gather(docs: DataFrame, lang_col: str, text_col: str, id_col: str, where, max_bytes: int, seed: int = 17) -> dict[str, bytes]:
    """Dictionary content for each language: texts joined up to CONTENT bytes, of each at most `max_bytes` (for fitting only).

    Texts come by a hash of the id, at most CANDIDATES a language, those of 200 to `max_bytes` bytes first; shorter and longer ones fill up.
    """
    docs = docs.select(id_col, lang_col, text_col)
    known = docs.where(where & F.col(lang_col).isNotNull() & F.regexp_like(text_col, F.lit(r"\p{L}")))
    size = F.octet_length(text_col)
    known = known.select(
        F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), F.least(size, F.lit(max_bytes)).alias("_bytes"),
        (~size.between(200, max_bytes)).alias("_other"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"),
    )
    # partial aggregation keeps a text for each slot in a task; CANDIDATES rows a language are left
    slots = known.groupBy("_lang", F.pmod("_h", F.lit(CANDIDATES)).alias("_slot")).agg(
        F.min(F.struct("_other", "_h", "_id", "_bytes")).alias("_x"), F.count("*").alias("_n"),
    )
    row = Window.partitionBy("_lang").orderBy("_x._other", "_x._h")
    before = F.coalesce(F.sum("_x._bytes").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = slots.select(
        "_lang", "_x._id", before.alias("_before"), F.row_number().over(row).alias("_nth"),
        F.sum("_n").over(Window.partitionBy("_lang")).alias("_rows"),
    )
    picked = ranked.where(F.col("_before") < CONTENT).collect()
    if not picked:
        return {}
    chosen = docs.sparkSession.createDataFrame([(r["_lang"], r["_id"], r["_nth"]) for r in picked], ranked.select("_lang", "_id", "_nth").schema)
    same = (F.col(lang_col) == F.col("_lang")) & F.col(id_col).eqNullSafe(F.col("_id"))
    # of rows that share an id and a language the least text stands for all
    rows = docs.where(where & F.regexp_like(text_col, F.lit(r"\p{L}"))).join(F.broadcast(chosen), same).groupBy("_lang", "_nth").agg(F.min(F.substring(text_col, 1, max_bytes)).alias("_t")).collect()
    out: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(lang, []).append(text.lower().encode()[:max_bytes])
    rows_of = {r["_lang"]: r["_rows"] for r in picked}
    return {lang: b"\n".join(out[lang])[:CONTENT] for lang in sorted(out, key=lambda x: (-rows_of[x], x))}


def identify(
    docs: DataFrame, folds: int = 4, held: int = 2, max_bytes: int = 1 << 14, min_margin: float = 0.01, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(id, held_out, lang_pred, score, margin, rejected) for every row.

    Dictionaries come from at most CONTENT bytes of texts a language (a bounded sample) outside the held-out fold; score is
    1 - (smallest size / mean of the other sizes), stretched to 0..1 by a factor of 2.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = gather(docs, lang_col, text_col, id_col, fold(id_col, folds) != held, max_bytes)

    @F.arrow_udf("struct<lang:string,score:double,margin:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Dictionaries(content)
        for texts in batches:
            langs, scores, margins = [], [], []
            for t in texts.to_pylist():
                if t is None or not own.names or not has_letter(t):
                    langs.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                size = own.sizes(t.lower().encode())
                k = int(np.argmin(size))
                rest = sorted(size[:k] + size[k + 1 :])
                langs.append(own.names[k])
                margins.append((rest[0] - size[k]) / max(rest[0], 1) if rest else 1.0)
                scores.append(min(1.0, 2 * (1 - size[k] * len(rest) / max(sum(rest), 1))) if rest else 1.0)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], ["lang", "score", "margin"],
            )

    got = docs.select(id_col, (fold(id_col, folds) == held).alias("held_out"), guess(text_col).alias("_g"))
    return got.select(
        id_col, "held_out", F.col("_g.lang").alias("lang_pred"), F.col("_g.score").alias("score"), F.col("_g.margin").alias("margin"),
        ((F.col("_g.lang") != UNKNOWN) & (F.col("_g.margin") < min_margin)).alias("rejected"),
    )
