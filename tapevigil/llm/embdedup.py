"""Embedding near-dedup: sign hashing in several tables, exact cosine verification, connected components.

Only vectors of one label and length are compared. Equal vectors of a label are
one class. A table's key is the signs of a class's vector against `bits` random
hyperplanes. `bits` follows the largest label's size, so that keys hold about
`OCCUPANCY` vectors each; the number of tables follows from the chance that a
pair at the threshold shares a key in some table, at least `recall`. Classes that
share a key are dealt into cells of bounded size (`operators.cells`), where cosines
are computed in double precision; a pair counts in the first table in which it
shares a key. Cells put out link counts and who is connected, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or have no label, link with nothing and are their own component;
repeated rows are linked with each other; an empty table gives an empty result.
Only named columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapevigil.llm.common import stored
from tapevigil.llm.graph import components, least_linked
from tapevigil.llm.hashing import mix
from tapevigil.operators.cells import blocked, celled, cells

THRESHOLD, RECALL = 0.93, 0.999
OCCUPANCY, BLOCK, SEED = 256, 256, 99


def tables(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables for a label of `largest` vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(largest, 1) / OCCUPANCY))))
    same_sign = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same_sign**bits))


def sign_keys(vectors: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Key of each vector (row) in each table (column)."""
    draw = np.random.Generator(np.random.PCG64([SEED, vectors.shape[1]]))
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return np.stack([(vectors @ draw.standard_normal((vectors.shape[1], bits)) > 0) @ powers for _ in range(count)], 1)


def usable(vector: F.Column, label: F.Column) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def keyed(classes: DataFrame, bits: int, count: int) -> DataFrame:
    """(cls, size, vector, keys): one mixed key per table, of label, length, table and signs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in np.unique(lengths := np.diff(np.asarray(batch.column(2).offsets))) if len(batch) else ():
                part = batch.filter(pa.array(lengths == length))
                signs = sign_keys(matrix(part.column(2)), bits, count)
                group = np.asarray(part.column(3)).view(np.uint64)[:, None]
                keys = mix(mix(signs + np.uint64(1)) ^ mix(group + np.arange(count, dtype=np.uint64)[None, :] + np.uint64(length) * np.uint64(4096)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * count), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["cls", "size", "vector", "keys"])

    rows = classes.select("cls", "size", "vector", F.xxhash64("label").alias("label_hash"))
    return rows.mapInArrow(scan, "cls binary, size long, vector array<double>, keys array<long>")


def verified(dealt: DataFrame, threshold: float) -> DataFrame:
    """(cls, root, links): what the cells find, a row per class and cell."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ("key", "a", "b")):
            cell = cell.combine_chunks().sort_by("cls")
            vectors = matrix(cell["vector"].combine_chunks())
            unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            own, keys, table = np.asarray(cell["own"]), np.asarray(cell["keys"].combine_chunks().flatten()).reshape(len(cell), -1), cell["table"][0].as_py()
            if cell["a"][0] != cell["b"][0]:
                near &= own[:, None] != own[None, :]
            for earlier in range(table):
                near &= keys[:, None, earlier] != keys[None, :, earlier]
            if near.any():
                linked, names = np.flatnonzero(near.any(axis=1)), cell["cls"].combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(linked)), names.take(pa.array(least_linked(near)[linked])), pa.array((near @ np.asarray(cell["size"]))[linked])],
                    names=["cls", "root", "links"],
                )

    ordered = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return ordered.mapInArrow(compare, "cls binary, root binary, links long")


def linked(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    vector, label = F.col(vector_col).cast("array<double>"), F.col(label_col)
    named = F.when(usable(vector, label), F.unhex(F.md5(F.concat_ws("|", label.cast("string"), vector.cast("string")).cast("binary"))))
    base = rows.select(F.col(id_col).alias("id"), named.alias("cls"), vector.alias("vector"), label.alias("label"))
    classes = stored(
        base.filter("cls IS NOT NULL").groupBy("cls")
        .agg(F.count("*").alias("size"), F.min("id").alias("least"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, count = tables(largest, threshold, recall)
    keys = stored(keyed(classes, bits, count))
    slim = keys.select("cls", F.posexplode("keys").alias("table", "key"))
    shared = stored(slim.groupBy("key").count().filter("count >= 2").select("key"))
    members = stored(keys.select("*", F.posexplode("keys").alias("table", "key")).join(shared, "key"))
    found = stored(verified(celled(blocked(members, ["key"], BLOCK), "cls"), threshold))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    info = classes.select("cls", "size", "least").join(groups, "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = stored(info.join(least, "component").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    out = base.select("id", "cls").join(info, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
