r"""Ranked lexical search: many queries at once, with their common parts evaluated once.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond
ASCII, with A to Z lower-cased. A task scans whole texts once and keeps, for each
document, its number of terms and the occurrences of the queries' terms. Sums over
these give the corpus statistics, these give each term's weight.

Queries are sets of terms, and a document's score is a sum over such a set. Sets of
terms that several queries share are mined in rounds: the pairs of nodes (terms,
then sets) that most queries have in common become nodes themselves, until no
pair is in two queries. For a slice of documents each node's accumulator is the sum
of its two parents', computed once; a query adds up its few remaining nodes. All
sums are of 64-bit integers, so their order does not matter. A task keeps the `top`
documents of each query; a window over tasks' lists ranks them.

Queries are taken in blocks with up to `BLOCK_TERMS` terms, or one query if it has
more. What is sent to tasks is bounded by a block, whatever the number of queries.

Defined results: a null or empty text has no terms; a document without terms
counts nowhere; a query without terms, or with none that the corpus holds, has no
rows; equal rows of queries (id and text) are one query, equal ids with different
texts are several; repeated documents are ranked one by one, null ids after all
others among equal scores; empty tables give an empty result. Ids of documents
are integers. Only named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapevigil.llm.common import stored

TOP = 10

#: Terms of a block of queries, and neighbours (most shared first) with which a node is paired when sets are mined.
BLOCK_TERMS, NEIGHBOURS = 50_000, 64

#: Cells of a slice's accumulators, bytes of a text that are split at a time.
CELLS, SPLIT_BYTES = 1 << 21, 4 << 20

#: A byte's lower-case letter or itself where it belongs to a term, else a space.
TERM_BYTE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Groups of tasks whose lists are merged before the last ranking.
SALTS = 64


def terms(raw: bytes | None) -> Iterator[list[bytes]]:
    """Lists of a text's terms in UTF-8."""
    plain, start = (raw or b"").translate(TERM_BYTE), 0
    while start < len(plain):
        end = plain.find(b" ", start + SPLIT_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


class Sharing:
    """The graph by which queries share sums: nodes below `leaves` are terms, levels hold (left, right) of the further ones."""

    def __init__(self, queries: list[list[int]], leaves: int, neighbours: int = NEIGHBOURS):
        self.leaves = self.nodes = leaves
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        sets = [sorted(set(q)) for q in queries]
        while pairs := self.common(sets, neighbours):
            partner = {}
            for new, (a, b) in enumerate(pairs, self.nodes):
                partner[a], partner[b] = (b, new), (a, new)
            sets = [self.merged(nodes, partner) for nodes in sets]
            self.levels.append((np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])))
            self.nodes += len(pairs)
        self.flat = np.array([n for nodes in sets for n in nodes], np.int64)
        self.starts = np.cumsum([0, *map(len, sets)])[:-1]

    @staticmethod
    def common(sets: list[list[int]], neighbours: int) -> list[tuple[int, int]]:
        """Pairs that two or more sets hold, the most common first, each node in one pair at most."""
        often = Counter(n for nodes in sets for n in nodes)
        count: Counter = Counter()
        for nodes in sets:
            shared = sorted((n for n in nodes if often[n] > 1), key=lambda n: (-often[n], n))
            for i, a in enumerate(shared):
                count.update((a, b) if a < b else (b, a) for b in shared[i + 1:i + 1 + neighbours])
        chosen, used = [], set()
        for pair, n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            if used.isdisjoint(pair):
                used.update(pair)
                chosen.append(pair)
        return chosen

    @staticmethod
    def merged(nodes: list[int], partner: dict[int, tuple[int, int]]) -> list[int]:
        held = set(nodes)
        out = {partner[n][1] if n in partner and partner[n][0] in held else n for n in nodes}
        return sorted(out)

    def scores(self, cells: np.ndarray) -> np.ndarray:
        """Sums of every query (row) from the terms' cells, which are the first rows of `cells`; fills the others."""
        at = self.leaves
        for left, right in self.levels:
            np.add(cells[left], cells[right], out=cells[at:at + len(left)])
            at += len(left)
        return np.add.reduceat(cells[self.flat], self.starts, axis=0)


class Best:
    """The best documents of each query so far."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.query = np.zeros(0, np.int64)
        self.score, self.id, self.null = self.query, self.query, np.zeros(0, bool)
        self.least = np.ones(queries, np.int64)
        self.last = np.full(queries, np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        least = self.least[:, None]
        query, at = np.nonzero((scores > least) | (scores == least) & (ids[None, :] <= self.last[:, None]))
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[query, at]])
        id, null = np.concatenate([self.id, ids[at]]), np.concatenate([self.null, null[at]])
        order = np.lexsort((id, null, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[rank < self.top]
        last = rank == self.top - 1
        self.least[query[last]], self.last[query[last]] = score[order[last]], id[order[last]]
        self.query, self.score, self.id, self.null = query[rank < self.top], score[kept], id[kept], null[kept]


def blocks(queries: DataFrame, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(id, terms) of queries that have terms, in blocks."""
    block, held = [], 0
    for name, raw in queries.distinct().toLocalIterator():
        own = sorted({t for part in terms(bytes(raw)) for t in part}) if raw is not None else []
        if block and held + len(own) > limit:
            yield block
            block, held = [], 0
        if own:
            block.append((name, own))
            held += len(own)
    if block:
        yield block


def occurrences(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of the documents with terms: all their terms' number, the known ones and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            rows, sizes, ends, found, times = [], [], [0], [], []
            for row, raw in enumerate(batch.column(1)):
                n, count = 0, Counter()
                for part in terms(raw.as_py()):
                    n += len(part)
                    count.update(map(number, part))
                if n:
                    count.pop(None, None)
                    rows.append(row)
                    sizes.append(n)
                    found.extend(count.keys())
                    times.extend(count.values())
                    ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((found, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(scan, "id long, n long, terms array<int>, tfs array<long>")


def candidates(found: DataFrame, sharing: Sharing, names: list, name_type: T.DataType, first: int, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, item, id, score): each task's best documents of every query of a block."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((sharing, weights, names))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item", name_type), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight, items = shared.value
        best = Best(len(items), top)
        width = max(1, CELLS // (graph.nodes + len(graph.flat)))
        for batch in batches:
            for at in range(0, len(batch), width):
                part = batch.slice(at, width)
                id, n, term, tf = part.columns
                docs = np.repeat(np.arange(len(part)), np.diff(np.asarray(term.offsets)))
                m = 10 + 90 * np.asarray(n) * n_docs // n_terms
                term, tf = np.asarray(term.flatten()), np.asarray(tf.flatten())
                cells = np.zeros((graph.nodes, len(part)), np.int64)
                cells[term, docs] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
                null = np.asarray(id.is_null())
                best.add(graph.scores(cells), np.asarray(id.fill_null(np.iinfo(np.int64).max)), null)
        if len(best.query):
            kind = pa.array(items).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query + first), pa.array([items[q] for q in best.query], kind), pa.array(best.id, mask=best.null), pa.array(best.score)], names=schema.names)

    return found.mapInArrow(rank, schema)


def ranked(lists: DataFrame, top: int) -> DataFrame:
    """The `top` rows of each query, numbered; tasks' lists are first merged in groups."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salted = lists.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merged = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = Window.partitionBy("query").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top).select("item", "rank", "id", "score")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): each query's `top` documents with the highest scores above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = queries.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    kind, first, lists, totals = asked.schema["item"].dataType, 0, None, None
    for block in blocks(asked, block_terms):
        known = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        found = stored(occurrences(rows, known))
        totals = totals or found.agg(F.count("*"), F.sum("n")).first()
        often = dict(map(tuple, found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
        weights = np.zeros(len(known), np.int64)
        for term, df in often.items():
            weights[term] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df + 1)))
        held = [(name, [known[t] for t in own if known[t] in often]) for name, own in block]
        held = [(name, own) for name, own in held if own]
        if held:
            sharing = Sharing([own for _, own in held], len(known))
            part = stored(candidates(found, sharing, [name for name, _ in held], kind, first, weights, *totals, top))
            lists = part if lists is None else lists.unionByName(part)
        first += len(block)
    if lists is None:
        schema = T.StructType([T.StructField("item", kind), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return ranked(lists, top)


PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL = rf"""
WITH terms AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')) AS term
  FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
sizes AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY rid),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
wanted AS (
  SELECT DISTINCT item_id, text,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')) AS term
  FROM benchmark),
tfs AS (SELECT rid, term, count(*) AS tf FROM terms SEMI JOIN wanted USING (term) GROUP BY rid, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM dfs, totals),
parts AS (
  SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM tfs JOIN weighed USING (term) JOIN sizes USING (rid), totals),
scores AS (
  SELECT item_id, text, rid, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score
  FROM scores JOIN sizes USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
