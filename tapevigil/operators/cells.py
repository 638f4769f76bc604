"""Comparing all members of a group in cells of bounded size.

A group's members are dealt into blocks by a hash; a cell holds one block, or two
blocks of one group, and one task compares what is in it. Cells have a bounded
number of rows whatever the group's size, and put out one row per member or
cell, not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapevigil.operators.series import on_keys
from tapevigil.plans.storage import settle

BLOCK = 128
#: Columns of a similarity matrix that are multiplied at a time.
CHUNK = 4096


def blocked(members: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """members, a written table, with `blocks`: how many blocks their group has."""
    sizes = settle(members.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    return on_keys(members, sizes, group)


def celled(members: DataFrame, member: str) -> DataFrame:
    """blocked members with cell columns a <= b and `own`, the member's block; a member comes once for each cell it is in."""
    own = F.pmod(F.xxhash64(F.lit(11), member), F.col("blocks")).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "blocks")


def cells(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches that are sorted by the cells' keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            if len(c) > 1:
                differ = pc.or_(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False), pc.not_equal(pc.is_null(c[1:]), pc.is_null(c[:-1])))
                new[1:] |= np.asarray(differ)
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0].as_py() for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Symmetric matrix of the numbers of values that two sets share; only for values of two or more sets on the diagonal."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])[:len(values)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] >= 2 if len(column) else new
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    found = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column.max(initial=-1)) + 1, CHUNK):
        inside = (column >= at) & (column < at + CHUNK)
        has = np.zeros((len(sets), CHUNK), np.float32)
        has[owner[inside], column[inside] - at] = 1
        found += has @ has.T
    return found


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric matrix of the pairs of sets with Jaccard similarity of `threshold` or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    both = common(sets)
    near = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    return near
