"""Vector codes: product quantisation in integers, compared in the Walsh-Hadamard domain.

Components are scaled to integers and vectors cut into equal parts, each with a
codebook of its own. To find a part's nearest entry, parts and entries are padded
with zeros to a power of two P and transformed by the integer Walsh-Hadamard
transform, which multiplies every squared distance by exactly P. Squared
differences are added up in sequency order: after the first coefficients the
nearest entry so far is measured in full, and an entry is out as soon as its sum
exceeds that; the rest are measured to the end. There is no floating point, so
distances and ties (to the lower entry) are exact.

Codebooks start as the parts of the first vectors by id. A round assigns all
parts and replaces each entry by its parts' mean, rounded down; entries without
parts stay. A task adds up counts and sums per part and entry, so what is shuffled
and gathered is bounded by parts x entries x a part's width, not by the rows.

Defined results: rows whose vector is null, or holds null or non-finite components,
are left out. Vectors shorter than the longest, and a length that the number of
parts does not divide, count as padded with zeros. Scaled components beyond
`limit(P)` count as that bound, so that all sums stay within 64 bits. Repeated
rows count each; equal ids start codebooks in the order of their vectors, null ids
come last; fewer rows than entries give smaller codebooks. `label_error` is null
where it would exceed 64 bits. An empty table gives an empty result. Only named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Rows that a task compares at a time, and the bound of stored components.
SLICE, BOUND = 2048, 1 << 28


def limit(padded: int) -> int:
    """The bound of a component's absolute value for parts padded to `padded`."""
    return BOUND // padded


def butterflies(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in natural order; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows


@cache
def sequency_order(width: int) -> np.ndarray:
    """Natural positions of the coefficients by their functions' number of sign changes."""
    functions = butterflies(np.eye(width, dtype=np.int64)).T
    return np.argsort((functions[:, 1:] != functions[:, :-1]).sum(axis=1), kind="stable")


def transformed(rows: np.ndarray) -> np.ndarray:
    """Rows padded with zeros to a power of two and transformed, coefficients in sequency order."""
    width = 1 << max(0, rows.shape[1] - 1).bit_length()
    padded = np.zeros((len(rows), width), np.int64)
    padded[:, :rows.shape[1]] = rows
    return butterflies(padded)[:, sequency_order(width)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, and the squared distance; both are given transformed."""
    width = parts.shape[1]
    head = max(1, width // 4)
    sums = ((parts[:, None, :head] - entries[None, :, :head]) ** 2).sum(axis=2)
    bound = ((parts - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for c in range(head, width):
        left = left + (parts[row, c] - entries[entry, c]) ** 2
        near = left <= bound[row]
        if not near.all():
            row, entry, left = row[near], entry[near], left[near]
    order = np.lexsort((entry, left, row))
    first = order[np.searchsorted(row[order], np.arange(len(parts)))]
    return entry[first], left[first] // width


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def scaled(vector: Column, scale: int) -> Column:
    """Components times scale, rounded down, as 32-bit integers within BOUND."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))


def matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) integers of a list column, padded with zeros and kept within the limit."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), parts * width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten())
    top = limit(1 << max(0, width - 1).bit_length())
    return np.clip(out, -top, top).reshape(len(column), parts, width)


def assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the rows, whose first column is the vector: with their parts, nearest entries and squared distances."""
    parts, _, width = books.shape
    entries = [transformed(book) for book in books]
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            piece = batch.slice(at, SLICE)
            rows = matrix(piece.column(0), parts, width)
            found = [nearest(transformed(rows[:, p]), entries[p]) for p in range(parts)]
            yield piece, rows, np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round."""
    parts, size, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for _, values, entry, _ in assigned(batches, books):
            for p in range(parts):
                count[p] += np.bincount(entry[:, p], minlength=size)
                np.add.at(sums[p], entry[:, p], values[:, p])
        part, entry = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists], names=["part", "entry", "n", "sums"])

    added = rows.select("vector").mapInArrow(add, "part long, entry long, n long, sums array<long>")
    totals = added.select("part", "entry", "n", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("n"), F.sum("col"))
    out = books.copy()
    for part, entry, pos, n, total in totals.collect():
        out[part, entry, pos] = total // n
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the parts of the first rows by id."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    vectors = pa.array([r[0] for r in first], pa.list_(pa.int32()))
    return matrix(vectors, parts, width).transpose(1, 0, 2).copy()


def coded(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every row that is kept, and the codebooks (part, entry, position); codes have a byte a part."""
    vector = F.col(vector_col).cast("array<double>")
    kept = stored(rows.filter(usable(vector)).select(scaled(vector, scale).alias("vector"), F.col(id_col).alias("id"), F.col(label_col).alias("label")))
    books = first_books(kept, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = improved(kept, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, entry, squares in assigned(batches, books):
            names = pa.array([bytes(x) for x in entry.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), names, pa.array(squares.sum(axis=1))], names=["id", "label", "code", "error"])

    schema = T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return kept.mapInArrow(code, schema), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with the sum of error over equal labels; null labels are equal."""
    codes = stored(codes)
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def _sql() -> str:
    books = """
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS c FROM parts WHERE rid <= 16)"""
    for r in range(ROUNDS + 1):
        books += f""",
a{r} AS MATERIALIZED (
  SELECT part, rid, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
  FROM (SELECT p.part, rid, entry, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
        FROM parts p JOIN b{r} b ON p.part = b.part)
  GROUP BY part, rid)"""
        if r < ROUNDS:
            books += f""",
s{r} AS (
  SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM parts JOIN a{r} USING (part, rid)) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)"""
    return f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x
  FROM (SELECT *, unnest(range({PARTS})) AS part FROM ints)),{books},
coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM ints JOIN coded USING (rid), books
"""


SQL = _sql()
