"""Substring dedup by seed and extend.

A window is `WINDOW` consecutive words of one text. Each word covered by a window
whose word sequence also starts anywhere else goes; windows are judged on the
input.

Seeds: every window has an anchor, its smallest `SEED`-gram by hash (winnowing),
so equal windows have equal anchors at equal offsets. An anchor occurrence owns a
stretch: the run of windows that choose it. Texts are joined on anchors that
occur at least twice. Extension: from the anchor both ways over its stretch.
Occurrences with equal stretches match in all of it; only where an anchor occurs
in different stretches are the windows compared one by one, once for each
different stretch however often it occurs. Matched windows that meet or overlap
are the maximal repeats, which are never shorter than a window.

Nothing lists pairs: a passage shared by many texts costs one row for each
occurrence, and hot anchors are pre-aggregated and joined by skew-split joins.

Defined results: a null text has no words; texts under `WINDOW` words keep all;
repeated rows (equal id and text) repeat each other's windows and lose them
alike; null ids are ids of their own; an empty table gives an empty result. All
input columns come back in `row`, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.llm.common import stored, text_slices
from tapevigil.llm.hashing import Words, least_of_runs, mix

WINDOW, SEED = 35, 8
#: Stands for a null id in keys.
NO_ID = -(1 << 63)
#: A stretch is packed as first window x SPAN + further windows.
SPAN = 64

ANCHORS = "d long, t binary, anchor long, stretch long, span long"
WINDOWS = "d long, t binary, anchor long, n long, word long, window long"


def anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Per anchor occurrence: text, anchor hash, stretch hash, first and last window (word indexes)."""
    runs, n_words = words.stretches(), len(words.hash)
    grams = runs.grams(seed)
    least = least_of_runs(grams, window - seed + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[:len(least)]
    whole = np.arange(len(least)) + window <= words.first[1:][text] if len(least) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.concatenate([[True], (np.diff(least[at]) != 0) | (np.diff(at) != 1) | (np.diff(text[at]) != 0)])
    lo = at[new]
    hi = np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
    stretch = mix(runs.of(lo, hi + window) ^ mix(((least[lo] - lo) * SPAN + (hi - lo)).astype(np.uint64)))
    assert n_words >= hi[-1] + window
    return text[lo], grams[least[lo]], stretch, lo, hi


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, t (together a row's key up to repeated rows), text and the whole row; t is the text's 128-bit digest, empty for null."""
    text = F.col(text_col)
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    t = F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))
    return docs.select(d.alias("d"), t.alias("t"), text.alias("text"), F.struct("*").alias("row"))


def found_anchors(keys: DataFrame, window: int, seed: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                words = Words(part.column(2))
                text, anchor, stretch, lo, hi = anchors(words, window, seed)
                span = (lo - words.first[text]) * SPAN + hi - lo
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), *map(pa.array, (anchor.view(np.int64), stretch.view(np.int64), span))],
                    names=["d", "t", "anchor", "stretch", "span"],
                )

    return keys.select("d", "t", "text").mapInArrow(scan, ANCHORS)


def windows_of(asked: DataFrame, window: int) -> DataFrame:
    """Each window of the stretches in asked(d, t, text, list of (anchor, span, n))."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                words = Words(part.column(2))
                lists = part.column(3)
                text = np.repeat(np.arange(len(part)), np.diff(np.asarray(lists.offsets)))
                anchor, span, n = (np.asarray(x) for x in lists.flatten().flatten())
                further = span % SPAN + 1
                row = np.repeat(np.arange(len(span)), further)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(further) - further, further)
                word = (span // SPAN)[row] + offset
                first = words.first[text[row]] + word
                hashes = mix(words.stretches().of(first, first + window))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text[row])), part.column(1).take(pa.array(text[row])), *map(pa.array, (anchor[row], n[row], word, hashes.view(np.int64)))],
                    names=["d", "t", "anchor", "n", "word", "window"],
                )

    return asked.mapInArrow(scan, WINDOWS)


def same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}.d") == F.col(f"{b}.d")) & (F.col(f"{a}.t") == F.col(f"{b}.t"))


def repeats(keys: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(d, t, spans): the packed stretches of repeated windows of each text that has any."""
    anchor_rows = found_anchors(keys, window, seed)
    seeds = stored(
        anchor_rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
        .filter("n >= 2").select("anchor", (F.col("a") != F.col("b")).alias("differ"))
    )
    seen = stored(anchor_rows.join(seeds, "anchor"))
    differ = seen.filter("differ")
    stretches = stored(
        differ.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "span")).alias("one"))
    )
    often = differ.join(stretches.filter("n >= 2").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
    asked = stretches.groupBy("one.d", "one.t").agg(F.collect_set(F.struct("anchor", "one.span", "n")).alias("list"))
    texts = keys.select("d", "t", "text").alias("x").join(asked.alias("y"), same_row("x", "y")).select("x.d", "x.t", "x.text", "y.list")
    windows = stored(windows_of(texts, window))
    hot = stored(windows.groupBy("anchor", "window").agg(F.sum("n").alias("all")).filter("all >= 2").select("anchor", "window"))
    single = windows.filter("n = 1").join(hot, ["anchor", "window"], "left_semi").select("d", "t", (F.col("word") * SPAN).alias("span"))
    spans = seen.filter("NOT differ").select("d", "t", "span").unionByName(often.select("d", "t", "span")).unionByName(single)
    return spans.groupBy("d", "t").agg(F.collect_set("span").alias("spans"))  # repeated rows have the same spans


def covered(n_words: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window of the stretches."""
    edges = np.zeros(n_words + 1, np.int64)
    lo = spans // SPAN
    np.add.at(edges, lo, 1)
    np.add.at(edges, lo + spans % SPAN + window, -1)
    return np.cumsum(edges[:-1]) > 0


def maximal(gone: np.ndarray) -> list[list[int]]:
    """[first, end) of each run of covered words."""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1).tolist()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(row, n_words, n_removed, kept, repeats) for every row: the words kept, and the maximal repeats removed."""
    keys = keyed(docs, id_col, text_col)

    @F.pandas_udf("n_words long, n_removed long, kept string, repeats array<array<long>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out = []
            for text, spans in zip(texts, lists, strict=True):
                words = text.encode().split() if text else []
                if spans is None or not len(spans):
                    out.append((len(words), 0, b" ".join(words).decode(), []))
                    continue
                gone = covered(len(words), np.asarray(spans), window)
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), int(gone.sum()), b" ".join(left).decode(), maximal(gone)))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "repeats"])

    joined = keys.alias("x").join(repeats(keys, window, seed).alias("y"), same_row("x", "y"), "left")
    return joined.select("x.row", cut(F.col("x.text"), F.col("y.spans")).alias("out")).select("row", "out.*")
