"""Text functions: variant keys, masks, patterns and marks of dirt. Each rule is plain and shown beside its results."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it; the plain \s of the regex engine is ASCII only. A class body, and the class.
BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{BLANK}]"

# The checks and formats that results must agree with.
DISGUISED = ["", "n/a", "null", "-", "sem informação"]
PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://\S+$",
    "phone": r"^\+?[0-9][0-9 ()-]{6,18}[0-9]$",
    "cpf": r"^[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}$",
    "cnpj": r"^[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}$",
    "cep": r"^[0-9]{5}-?[0-9]{3}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
DIRT = {
    "edge_space": rf"^{SPACE}|{SPACE}\z",
    "double_space": SPACE + "{2,}",
    "invisible": r"[\x{200B}-\x{200D}\x{A0}\x{FEFF}]",
    "control": r"[\x00-\x1f\x7f]",
    "repeated": r"(?s)(.)\1{3,}",
    "mojibake": r"Ã©|Ã£|â€™",
    "digits": r"[0-9]",
    "letters": r"\p{L}",
    "html": r"&[a-zA-Z]+;|<[a-zA-Z/][^>]*>|\\n",
}


def normal_key(text: str) -> str:
    """Edges trimmed, lower case, compatibility forms without accents, white space as single blanks."""
    plain = unicodedata.normalize("NFKD", text.strip().lower())
    return " ".join("".join(ch for ch in plain if not unicodedata.combining(ch)).split())


@F.pandas_udf(T.StringType())
def variant_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """normal_key of each value; meant for distinct levels, as it runs in Python."""
    for batch in batches:
        yield batch.map(lambda t: None if t is None else normal_key(t))


def ascii_key(text: Column) -> Column:
    """The key where only Latin accents occur, without leaving the JVM."""
    accents, plain = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"
    return F.trim(F.regexp_replace(F.translate(F.lower(text), accents, plain), SPACE + "+", " "))


def strip(text: Column) -> Column:
    """The text without white space at its edges, as Unicode has it."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def mask(text: Column) -> Column:
    """Capitals as A, small letters as a, digits as 9."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{Nd}", "9")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def disguised(text: Column) -> Column:
    """Whether a value stands for a missing one."""
    return F.lower(strip(text)).isin(DISGUISED)


def letter_case(text: Column) -> Column:
    """lower, upper, title, mixed; none without a cased letter."""
    cased = F.lower(text) != F.upper(text)
    return F.when(~cased, "none").when(text == F.lower(text), "lower").when(text == F.upper(text), "upper").when(text == F.initcap(text), "title").otherwise("mixed")


def dirt(text: Column) -> dict[str, Column]:
    """Each check of the battery as a predicate. Where a check needs some character, that is looked for before the pattern."""
    out = {name: text.rlike(rule) for name, rule in DIRT.items()}
    any_of = lambda *marks: reduce(or_, [text.contains(m) for m in marks])
    out["mojibake"] = any_of(*DIRT["mojibake"].split("|"))
    out["html"] = any_of("&", "<", "\\n") & out["html"]
    out["edge_space"] = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(SPACE)
    out["control_no_space"] = text.rlike(r"[\x00-\x08\x0e-\x1f\x7f]")
    out["mixed_alphabets"] = text.rlike(r"[\p{IsCyrillic}\p{IsGreek}]") & text.rlike(r"\p{IsLatin}")
    return out


def leading_number(text: Column) -> Column:
    """The number that a label begins with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([0-9]+)", 1), F.lit("")).try_cast("bigint")
