"""Packing token ids into windows of one length by minimum bin slack.

A document's ids are those of its text by the tokenizers library, then an end id.
A task packs the documents it reads. As long as a document has a window's worth of
ids left, they are a window of their own; its rest waits in a pool. Where the pool
is full, windows are filled from it: the longest rest first, then the multiset
of remaining lengths that comes closest to the capacity. That is a subset-sum
dynamic program: bit s of an integer says that the sum s can be reached, a length
with n copies shifts and joins the integer about log2(n) times, and how many copies
of each length make up the best sum is traced back. A multiset is used as often
as its lengths last. If slack is left, the longest rest of the pool is cut to fill
it. At a task's end less than a window is left in the pool; it is cut into windows
whose lengths are powers of two, which need no padding.

So no window is padded, tasks depend on no other task, nothing is shuffled, and
a task holds one document and a pool of bounded size.

Ids: a match of the pre-token pattern is encoded once by the library and kept in
tables of bounded size. Texts with characters on whose class Unicode versions may
differ are encoded by the library as a whole, long ones cut at safe boundaries.

Defined results: a null text counts as empty, an empty text is its end id alone;
repeated rows are packed one by one; rows without an id keep a null one; an empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tapevigil.llm.bpe import pieces, rank_file

WINDOW, END = 2048, 1

#: Ids and stretches that a task's pool holds before windows are filled.
POOL_TOKENS, POOL_STRETCHES = 1 << 21, 1 << 16

#: Pre-tokens of each of two generations whose ids a worker keeps, characters that are encoded at a time, and bytes
#: of ids that a task puts out at a time.
KEPT, GROUP_CHARS, OUT_BYTES = 1 << 19, 1 << 17, 4 << 20

#: Characters outside blocks whose letters and numbers no Unicode version of the last ten years has changed,
#: and the four separators on which libraries differ.
UNSETTLED = r"[^\x00-\x1B\x20-\u04FF\u2000-\u206F\u20A0-\u20BF\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FD5\uAC00-\uD7A3]"

_ENCODERS: dict[int, Encoder] = {}


def spelt_out(pattern: str) -> str:
    """The pattern with its character properties written as ranges, for settled characters."""
    import regex

    unsettled = re.compile(UNSETTLED)
    settled = "".join(c for c in map(chr, range(0xD800)) if not unsettled.match(c))
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part.startswith(r"\p"):
            runs = "".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for r in regex.findall(f"{part}+", settled) for x in consecutive(r))
            out.append(runs if inside else f"[{runs}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def consecutive(chars: str) -> list[str]:
    """Stretches whose code points follow each other."""
    cuts = [i for i in range(1, len(chars)) if ord(chars[i]) != ord(chars[i - 1]) + 1]
    return [chars[i:j] for i, j in zip([0, *cuts], [*cuts, len(chars)])]


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: bytes, pattern: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.library.encode_special_tokens = True
        # The same model for many pre-tokens in one text, each byte as the character that stands for it, between line ends.
        alphabet = iter(c for c in sorted(pre_tokenizers.ByteLevel.alphabet()) if ord(c) > 255)
        shown = [chr(b) if chr(b) in pre_tokenizers.ByteLevel.alphabet() else next(alphabet) for b in range(256)]
        self.shown, line_end = "".join(shown), shown[0x0A]
        self.line_end_id = self.library.token_to_id(line_end)
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(line_end, "isolated")
        self.split, self.unsettled = re.compile(spelt_out(pattern)).findall, re.compile(UNSETTLED).search
        # A full generation becomes the older one, from which pre-tokens that are met again come back.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = kept

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[tuple[str, bytes]]:
        """Pre-tokens with their ids."""
        lines = [w for w in words if "\n" not in w]
        if not lines:
            return list(zip(words, self.plain(words)))
        shown = charmap_decode("\n".join(lines).encode(), "strict", self.shown)[0]
        ids = np.asarray(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = [*(np.flatnonzero(ids == self.line_end_id) * 4).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        spaced = [w for w in words if "\n" in w]
        ids_of = [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
        return [*zip(lines, ids_of, strict=True), *zip(spaced, self.plain(spaced))]

    def settled(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of settled characters, by way of their pre-tokens."""
        words = [self.split(t) for t in texts]
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        unique = set().union(*words)
        unknown = unique.difference(self.known)
        again = {w: self.older[w] for w in unknown if w in self.older}
        self.known.update(again)
        self.known.update(self.words(list(unknown.difference(again))))
        # A group's own table is small enough to stay in the processor's cache.
        here = dict(zip(unique, map(self.known.__getitem__, unique)))
        ids_of = here.__getitem__
        return [b"".join(map(ids_of, w)) for w in words]

    def all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; null counts as empty."""
        done: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        chars = 0

        def flush() -> None:
            for (i, _), ids in zip(group, self.settled([t for _, t in group])):
                done[i].append(ids)
            group.clear()

        for i, text in enumerate(texts):
            if text and self.unsettled(text):
                done[i] = self.plain(list(pieces(text)))
                continue
            for piece in pieces(text or ""):
                group.append((i, piece))
                chars += len(piece)
                if chars > GROUP_CHARS:
                    flush()
                    chars = 0
        flush()
        return map(b"".join, done)


def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """The worker's encoder, with what it knows from earlier tasks."""
    key = hash((vocabulary, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, pattern)
    return _ENCODERS[key]


def closest(counts: dict[int, int], longest_first: Iterable[int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum not above capacity."""
    reach, steps = 1, []
    goal, mask = 1 << capacity, (1 << capacity + 1) - 1
    for length in longest_first:
        if reach & goal:
            break
        copies, part = min(counts[length], capacity // length), 1
        if copies:
            steps.append((length, reach))
        while copies:
            part = min(part, copies)
            reach |= (reach << length * part) & mask
            copies -= part
            part *= 2
    left, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> left & 1:
            left -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


class Pool:
    """Stretches (id, start, packed ids, ids of the document) that wait for a window, by length."""

    def __init__(self, window: int):
        self.window, self.tokens, self.stretches = window, 0, 0
        self.waiting: dict[int, list[tuple]] = {}
        self.count: dict[int, int] = defaultdict(int)
        self.lengths: list[int] = []

    def put(self, stretch: tuple) -> None:
        length = len(stretch[2]) // 4
        if length not in self.waiting:
            insort(self.lengths, length)
            self.waiting[length] = []
        self.waiting[length].append(stretch)
        self.count[length] += 1
        self.tokens += length
        self.stretches += 1

    def take(self, length: int) -> tuple:
        stretch = self.waiting[length].pop()
        self.count[length] -= 1
        if not self.count[length]:
            del self.waiting[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        self.tokens -= length
        self.stretches -= 1
        return stretch

    def filled(self) -> Iterator[list[tuple]]:
        """Windows without slack: one multiset, as often as it lasts. The pool must hold a window's worth."""
        longest = self.lengths[-1]
        self.count[longest] -= 1
        taken = closest(self.count, reversed(self.lengths), self.window - longest)
        self.count[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        slack = self.window - sum(length * n for length, n in taken.items())
        times = 1 if slack else min(self.count[length] // n for length, n in taken.items())
        for _ in range(times):
            window = [self.take(length) for length, n in sorted(taken.items(), reverse=True) for _ in range(n)]
            if slack:
                name, start, ids, total = self.take(self.lengths[-1])
                window.append((name, start, ids[:4 * slack], total))
                self.put((name, start + slack, ids[4 * slack:], total))
            yield window

    def rest(self) -> Iterator[list[tuple]]:
        """Windows whose lengths are powers of two, the longest first, of all that waits; less than a window."""
        bits = [1 << b for b in reversed(range(self.tokens.bit_length())) if self.tokens >> b & 1]
        for size in bits:
            window = []
            while size:
                name, start, ids, total = self.take(self.lengths[-1])
                window.append((name, start, ids[:4 * size], total))
                if len(ids) > 4 * size:
                    self.put((name, start + size, ids[4 * size:], total))
                size -= len(window[-1][2]) // 4
            yield window


def windows(documents: Iterable[tuple], window: int, pool_tokens: int, pool_stretches: int) -> Iterator[list[tuple]]:
    """All windows of (id, packed ids) rows, each a list of stretches in order."""
    pool, size = Pool(window), 4 * window
    for name, ids in documents:
        whole, total = len(ids) // size * size, len(ids) // 4
        for at in range(0, whole, size):
            yield [(name, at // 4, ids[at:at + size], total)]
        if whole < len(ids):
            pool.put((name, whole // 4, ids[whole:], total))
        if pool.tokens >= pool_tokens or pool.stretches >= pool_stretches:
            while pool.tokens > max(pool_tokens // 2, window) or pool.stretches > pool_stretches // 2 and pool.tokens >= window:
                yield from pool.filled()
    while pool.tokens >= window:
        yield from pool.filled()
    yield from pool.rest()


def packed(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           end: int = END, pool_tokens: int = POOL_TOKENS, pool_stretches: int = POOL_STRETCHES) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are packed 32-bit integers."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(rank_file(vocabulary))
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
         T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kind = np.asarray([end], "<u4").tobytes(), None

        def documents():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for name, ids in zip(batch.column(0).to_pylist(), encoder(shared.value, pattern).all(batch.column(1).to_pylist())):
                    yield name, ids + last

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        # As in monotonically_increasing_id: the task's number, then a count.
        sequence, rows, held = TaskContext.get().partitionId() << 33, [], 0
        for stretches in windows(documents(), window, pool_tokens, pool_stretches):
            offset = 0
            for name, start, ids, total in stretches:
                length = len(ids) // 4
                rows.append((name, start, length, ids, total, sequence, offset))
                offset += length
            sequence, held = sequence + 1, held + 4 * offset
            if held >= OUT_BYTES or len(rows) >= 1 << 16:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
