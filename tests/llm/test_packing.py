"""Packing against what windows must be, and ids against the library."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tapevigil.llm import packing
from tapevigil.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.rank_file(PATH), PATTERN)


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(list(texts), add_special_tokens=False)]


def texts():
    rng = random.Random(3)
    words = ["the", "Ünïcode", "don't", "12345", "  ", "\n\n", "\t", "漢字", "กา", "🙂", "...", "x" * 50, "<|endoftext|>", " "]
    rows = [None, "", " ", "a", "\x00", "\x1c\x1d"] + [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(150)]
    return rows + ["word " * 60_000, "y" * 9_000, rows[20], rows[20]] + ["copy of one text"] * 300


def check(rows, want, window):
    """Pieces cover each document's ids once, sequences are gapless and unpadded; the number of sequences."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1]
        total = sum(n for _, n in spans)
        assert total == window or total < window and total & (total - 1) == 0
    got = defaultdict(list)
    for r in rows:
        got[r["doc_tokens"]].append((r["start"], r["length"], bytes(r["ids"])))
    # Pieces of documents with equal ids can't be told apart: they must make up the documents' ids as a whole.
    for total, pieces in got.items():
        same = [np.asarray(w, "<u4").tobytes() for w in want if len(w) == total]
        assert sum(n for _, n, _ in pieces) == total * len(same)
        starts = defaultdict(list)
        for start, n, ids in pieces:
            starts[start].append((n, ids))
        assert len(starts[0]) == len(same)
        for start, cut in starts.items():
            assert all(any(ids == s[4 * start:4 * (start + n)] for s in same) for n, ids in cut)
    assert sorted(got) == sorted({len(w) for w in want})
    return len(by_sequence)


@pytest.mark.parametrize("window,pool", [(2048, packing.POOL_TOKENS), (64, 300)])
def test_pieces_make_up_the_documents(spark, window, pool):
    docs = [(None if i == 7 else i // 2, t, "z", 1, 2) for i, t in enumerate(texts())]
    table = spark.createDataFrame(docs, "doc_id long, text string, ids string, start int, length int").repartition(3)
    rows = packing.packed(table, PATH, PATTERN, window=window, pool_tokens=pool, pool_stretches=50).collect()
    want = [[*ids, packing.END] for ids in library_ids(t or "" for t in texts())]
    sequences = check(rows, want, window)
    assert sequences <= sum(map(len, want)) // window + 3 * 11
    assert packing.packed(table.limit(0), PATH, PATTERN).collect() == []


def test_ids_are_those_of_the_library(encoder):
    rows = [t or "" for t in texts()]
    want = library_ids(rows)
    small = packing.Encoder(packing.rank_file(PATH), PATTERN, kept=50)
    for e in (encoder, small, small):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in e.all(rows)] == want
    assert all(e.settled([]) == [] and list(e.all([None, ""])) == [b"", b""] for e in (encoder, small))


def test_settled_characters_are_split_as_the_library_does(encoder):
    held = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not encoder.unsettled(chr(c))]
    rows = [f"a{c}b {c}{c} 1{c}2 .{c}.  {c} \n{c}\n x{c}" for c in held]
    assert encoder.settled(rows) == encoder.plain(rows) and len(held) > 30_000


def test_closest_sum_is_the_best_one():
    rng = random.Random(6)
    for _ in range(300):
        counts = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(rng.randrange(1, 6))}
        capacity = rng.randrange(0, 120)
        taken = packing.closest(counts, sorted(counts, reverse=True), capacity)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert all(n <= counts[length] for length, n in taken.items())
        assert sum(length * n for length, n in taken.items()) == max(s for s in sums if s <= capacity)


def test_multisets_are_preferred_to_cuts():
    documents = [(i, bytes(4 * n)) for i, n in enumerate([700, 700, 648, 1000, 1048, 2048, 2047, 1])]
    out = list(packing.windows(documents, 2048, 1 << 20, 100))
    assert len(out) == 4 and sum(map(len, out)) == len(documents)
    alike = list(packing.windows([(i, bytes(2800)) for i in range(1000)], 2048, 1 << 20, 100))
    assert sum(len(ids) for w in alike for _, _, ids, _ in w) == 2_800_000
    assert len(alike) <= 700_000 // 2048 + 11


def test_query_covers_all_documents(spark, sf):
    rows = QUERIES["op13_packing"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, library_ids(t or "" for t in docs.values())))
    seen = defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
    assert seen.keys() == docs.keys()
    for name, pieces in seen.items():
        ids, at = [*want[name], packing.END], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"]:at], "<u4").tobytes())
        assert at == len(ids)
