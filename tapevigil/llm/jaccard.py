"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with equal sets of word `N`-grams are one class (similarity 1). Each class
has a signature of `TREES` sequences of minhashes, one for each tree of a forest
of prefix tries. Classes that share a prefix in a tree are candidates. Prefixes
start at the longest length at which the chance that a pair at the threshold
shares one in some tree, 1 - (1 - s^length)^trees, reaches `recall`; a trie node
of at most `CROWD` classes shortens its prefix by one more, which raises recall
where it is cheap. Chains of candidates are dealt into cells of bounded size
(`operators.cells`), where all similarities are computed exactly from the n-gram
sets. Cells put out link counts and who is connected, never pairs.

Defined results: a text of 1 to N - 1 words has one n-gram, all its words; a text
without words, or a null text, links with nothing and its class is its own id;
equal texts are linked, whatever their ids; null ids are never a class id unless
a class has no other; an empty table gives an empty result. Only named columns
are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapevigil.llm.common import WORD, stored, text_slices
from tapevigil.llm.graph import components, least_linked
from tapevigil.llm.hashing import Words, mix
from tapevigil.llm.substring import NO_ID, keyed, same_row
from tapevigil.operators.cells import blocked, celled, cells, similar

N, THRESHOLD = 5, 0.8
TREES, RECALL, CROWD = 20, 0.9995, 32


def longest_prefix(threshold: float, recall: float, trees: int) -> int:
    """The longest prefix whose collision chance in some tree reaches `recall` at the threshold."""
    length = 1
    while 1 - (1 - threshold ** (length + 1)) ** trees >= recall:
        length += 1
    return length


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each text, and each text's first one (and one past the last)."""
    runs, sizes = words.stretches(), np.diff(words.first)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    text = np.repeat(np.arange(len(sizes)), counts)
    start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(sizes[text], n)
    hashes = mix(runs.of(start, start + length) + length.astype(np.uint64))
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(sizes) + 1))


def signatures(grams: np.ndarray, first: np.ndarray, trees: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text with n-grams: its minhash prefixes of length - 1 and of `length`, hashed, one column per tree."""
    full = np.flatnonzero(np.diff(first))
    draw = np.random.Generator(np.random.PCG64(77))
    short, long = (np.zeros((len(full), trees), np.uint64) for _ in range(2))
    for tree in range(trees):
        key = np.full(len(full), tree + 1, np.uint64)
        for depth in range(length):
            factor, shift = np.uint64(draw.integers(0, 1 << 63) * 2 + 1), np.uint64(draw.integers(0, 1 << 63))
            least = np.minimum.reduceat((grams ^ shift) * factor, first[full]) if len(full) else key
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            if depth == length - 2:
                short[:, tree] = key
        long[:, tree] = key
    return short, long


def set_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit key of each text's set of n-grams, as 16 bytes."""
    key = np.zeros((len(first) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for i, salt in enumerate((3, 5)):
            key[full, i] = mix(np.add.reduceat(mix(grams * np.uint64(salt) + np.uint64(salt)), first[full]) + np.diff(first)[full].astype(np.uint64))
    return key


def sketch(keys: DataFrame, n: int, trees: int, length: int) -> DataFrame:
    """(d, t, cls, short, long) per row: its class (null without words) and its prefixes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                grams, first = gram_sets(Words(part.column(2)), n)
                full = np.flatnonzero(np.diff(first))
                cls = np.ascontiguousarray(set_keys(grams, first)).view("V16").ravel()
                empty = np.diff(first) == 0
                named = pa.array([None if e else c.tobytes() for c, e in zip(cls, empty, strict=True)], pa.binary())
                lists = []
                for prefixes in signatures(grams, first, trees, length):
                    offsets = np.zeros(len(part) + 1, np.int32)
                    offsets[1 + full] = trees
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(prefixes.ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), named, *lists], names=["d", "t", "cls", "short", "long"])

    return keys.select("d", "t", "text").mapInArrow(scan, "d long, t binary, cls binary, short array<long>, long array<long>")


def candidates(classes: DataFrame, crowd: int) -> DataFrame:
    """links(a, b) from each class to the smallest class of each trie node that it shares."""
    rows = classes.select("cls", F.explode(F.arrays_zip("short", "long")).alias("p")).select("cls", "p.short", "p.long")
    nodes = stored(rows.groupBy("short").agg(F.count("*").alias("n"), F.min("cls").alias("lead")).filter("n >= 2"))
    shared = stored(rows.join(nodes, "short"))
    sparse = shared.filter(F.col("n") <= crowd).select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    crowded = shared.filter(F.col("n") > crowd).select("cls", "long")
    leads = stored(crowded.groupBy("long").agg(F.count("*").alias("n"), F.min("cls").alias("lead")).filter("n >= 2").drop("n"))
    return sparse.unionByName(crowded.join(leads, "long").select(F.col("cls").alias("a"), F.col("lead").alias("b"))).distinct()


def verified(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cls, root, links): what the cells of texts(g, cls, size, blocks, text) find, a row per class and cell."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 4):
                hashes, first = gram_sets(Words(part.column(4)), n)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], names=["g", "cls", "size", "blocks", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ("g", "a", "b")):
            cell = cell.combine_chunks().sort_by("cls")
            lists = cell["grams"].chunk(0) if cell["grams"].num_chunks else None
            sets = [np.asarray(lists[i].values) for i in range(len(lists))]
            own, size = np.asarray(cell["own"]), np.asarray(cell["size"])
            near = similar(sets, threshold)
            if cell["a"][0].as_py() != cell["b"][0].as_py():
                near &= own[:, None] != own[None, :]
            if near.any():
                linked = np.flatnonzero(near.any(axis=1))
                names = cell["cls"].combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(linked)), names.take(pa.array(least_linked(near)[linked])), pa.array((near @ size)[linked])],
                    names=["cls", "root", "links"],
                )

    sets = texts.mapInArrow(grams, "g binary, cls binary, size long, blocks int, grams array<long>")
    dealt = celled(sets, "cls").repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")
    return dealt.mapInArrow(compare, "cls binary, root binary, links long")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
           trees: int = TREES, recall: float = RECALL, crowd: int = CROWD) -> DataFrame:
    """(id, d, t, class_id, n_links, first) per row.

    class_id is the smallest id that links lead to, n_links the number of other rows linked directly; `first` marks
    the row of each linked group that `distinct_documents` keeps.
    """
    keys = keyed(docs, id_col, text_col)
    rows = stored(sketch(keys, n, trees, longest_prefix(threshold, recall, trees)))
    real = F.when(F.col("d") != NO_ID, F.col("d"))
    classes = stored(
        rows.filter("cls IS NOT NULL").groupBy("cls")
        .agg(F.count("*").alias("size"), F.min(real).alias("least"), F.min(F.struct(F.col("d") == NO_ID, "d", "t")).alias("one"), F.first("short").alias("short"), F.first("long").alias("long"))
    )
    chains = components(candidates(classes, crowd))
    active = stored(chains.join(classes, chains.node == classes.cls).select(F.col("component").alias("g"), "cls", "size", "one"))
    asked = blocked(active, ["g"]).select("g", "cls", "size", "blocks", "one.d", "one.t")
    texts = asked.alias("y").join(keys.select("d", "t", "text").alias("x"), same_row("x", "y"))
    # Repeated rows bring the same text again; a class needs it once.
    texts = texts.select("y.g", "y.cls", "y.size", "y.blocks", "x.text").dropDuplicates(["cls"])
    found = stored(verified(texts, n, threshold))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    named = classes.select("cls", "size", "least", "one").join(groups, "cls", "left").join(links, "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("class_id"), F.min("one").alias("home"))
    links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    named = stored(named.join(least, "component").select("cls", "class_id", "home.d", "home.t", links.alias("n_links")))
    x, y = rows.select("d", "t", "cls").alias("x"), named.alias("y")
    out = x.join(y, F.col("x.cls") == F.col("y.cls"), "left")
    alone = F.col("x.cls").isNull()
    own = F.when(F.col("x.d") != NO_ID, F.col("x.d"))
    return out.select(
        own.alias("id"), "x.d", "x.t", F.when(alone, own).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | same_row("x", "y")).alias("first"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns: one row of each linked group, the smallest id's, and every row without words."""
    kept = stored(joined(docs, id_col, text_col, **options).filter("first").select("d", "t").distinct())
    keys = keyed(docs, id_col, text_col).withColumn("wordless", ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    rows = keys.filter("NOT wordless").select("d", "t", "row").alias("x").join(kept.alias("y"), same_row("x", "y"))
    linked = rows.select("x.d", "x.t", "x.row").dropDuplicates(["d", "t"])
    return linked.select("row").unionByName(keys.filter("wordless").select("row")).select("row.*")
