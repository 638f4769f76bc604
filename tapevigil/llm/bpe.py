"""Byte-level BPE encoding and decoding with a local rank file.

`encode` gives every text its token ids by the tiktoken library, packed as
little-endian unsigned 32-bit integers, the form in which token files are kept;
`decode` turns packed ids back into raw bytes, which need not be whole UTF-8.

Long texts are cut at safe boundaries before they are encoded: a space between
two characters that are not white space always begins a match of the pattern,
and nothing to its left looks beyond it, so the ids are those of the whole text.

Defined results: a null text counts as empty, an empty text has no ids, equal
texts have equal ids. No other column is read, so their names don't matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A space between two characters that are not white space, and room after it.
SAFE = re.compile(r"(?<=\S) (?=\S)")

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 100_000

_ENCODINGS: dict[int, object] = {}


def rank_file(path: str) -> bytes:
    """The rank file's bytes, read where the driver runs; a vocabulary is under a few MB."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def encoding(raw: bytes, pattern: str):
    """The library's encoder, built once per worker process."""
    import tiktoken

    key = hash((raw, pattern))
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})
    return _ENCODINGS[key]


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut text at the first safe boundary after each `limit` characters."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(codec, text: str | None, limit: int = PIECE_CHARS) -> np.ndarray:
    if not text:
        return np.zeros(0, "<u4")
    return np.concatenate([np.asarray(codec.encode_ordinary(p), "<u4") for p in pieces(text, limit)])


def decode_ids(codec, packed: bytes | None) -> bytes:
    return codec.decode_bytes(np.frombuffer(packed, "<u4").tolist()) if packed else b""


def encode(spark: SparkSession, text: Column, ranks: str, pattern: str, limit: int = PIECE_CHARS) -> Column:
    """Packed ids (binary, 4 bytes each) of a text column."""
    shared = spark.sparkContext.broadcast(rank_file(ranks))

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoding(shared.value, pattern)
        for texts in batches:
            yield pd.Series([encode_text(codec, t, limit).tobytes() for t in texts], dtype=object)

    return ids(text)


def decode(spark: SparkSession, packed: Column, ranks: str, pattern: str) -> Column:
    """Raw bytes of a column of packed ids."""
    shared = spark.sparkContext.broadcast(rank_file(ranks))

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = encoding(shared.value, pattern)
        for ids in batches:
            yield pd.Series([decode_ids(codec, x) for x in ids], dtype=object)

    return raw(packed)


def round_trip(spark: SparkSession, text: Column, ranks: str, pattern: str, limit: int = PIECE_CHARS) -> Column:
    """struct(ids, raw): packed ids of a text column and the bytes they decode to, by one worker a task."""
    shared = spark.sparkContext.broadcast(rank_file(ranks))

    @F.pandas_udf("ids binary, raw binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = encoding(shared.value, pattern)
        for texts in batches:
            ids = [encode_text(codec, t, limit).tobytes() for t in texts]
            yield pd.DataFrame({"ids": ids, "raw": [decode_ids(codec, x) for x in ids]}, dtype=object)

    return both(text)


def token_count(packed: Column) -> Column:
    return F.coalesce((F.octet_length(packed) / 4).cast("long"), F.lit(0).cast("long"))
