"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than LONG characters are cut where no match of the pattern can reach across: before white space that
follows other text, and between letters and digits. The pieces' ids are the whole text's ids. Decoding joins the tokens' raw
bytes, so that a token that ends inside a character is no loss.

A null counts as empty: no ids, and the digests of no bytes. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import small_batches

LONG = 1 << 15
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


class Codec:
    """Encoder and decoder of one rank file and one pattern, without special tokens."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def pieces(text: str, most: int = LONG) -> Iterator[str]:
    """Whole-text pieces of about `most` characters, cut only at safe places."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: One codec for each file and pattern in a Python worker.
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    if (rank_file, pattern) not in _CODECS:
        _CODECS[rank_file, pattern] = Codec(rank_file, pattern)
    return _CODECS[rank_file, pattern]


def encode_column(text: str | Column, rank_file: str, pattern: str) -> Column:
    """The ids of each text as array<int>."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(rank_file, pattern)
        for texts in batches:
            yield pa.array([own.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(text)


def decode_column(ids: str | Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes of each array of ids."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(rank_file, pattern)
        for arrays in batches:
            yield pa.array([own.decode(x or []) for x in arrays.to_pylist()], pa.binary())

    return decode(ids)


def digest_column(text: str | Column, rank_file: str, pattern: str) -> Column:
    """Encodes and decodes each text in one pass: (n_tokens, ids_sha256, decoded_sha256)."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(rank_file, pattern)
        for texts in batches:
            n, a, b = [], [], []
            for t in texts.to_pylist():
                ids = own.encode(t or "")
                n.append(len(ids))
                a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digest(text)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", into: str = "token_ids") -> DataFrame:
    """`docs` with the ids of each text in `into`."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, encode_column(F.col(text_col), rank_file, pattern))


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of each array of ids in `into`."""
    small_batches(encoded.sparkSession)
    return encoded.withColumn(into, decode_column(F.col(ids_col), rank_file, pattern))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row."""
    small_batches(docs.sparkSession)
    got = docs.select(id_col, digest_column(F.col(text_col), rank_file, pattern).alias("_d"))
    return got.select(id_col, *[F.col(f"_d.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])
