"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
trigram's vector binds (multiplies) its letters' vectors, permuted by position
(rotated twice, once, not at all); a text's vector bundles (adds) its trigrams'
vectors. A language's prototype bundles the unit vectors of labelled texts, and
a text gets the language whose prototype has the largest cosine with it. Letters
are lower-cased; each run of other characters is one word boundary, which has a
vector of its own.

`fit` draws about `rows_per_language` labelled rows of each language by a hash of
their ids, so its work is bounded and reruns agree; all sums are of integers.

Defined results: null texts and texts without letters get UNKNOWN with score 0,
as does every text when nothing is labelled; equal cosines go to the language
first in code point order; the score is the cosine, not below 0. Only named
columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 1024
SEED = 20_240
#: Trigram vectors that a worker keeps before it starts anew.
KEPT_TRIGRAMS = 60_000


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams, packed 21 bits a symbol, and their counts; a trigram has a letter in its middle."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = np.concatenate([[0], np.where(letters()[points], points, 0), [0]]).astype(np.int64)
    symbols = symbols[(symbols != 0) | np.concatenate([[True], symbols[:-1] != 0])]
    if symbols[-1]:
        symbols = np.append(symbols, 0)
    packed = symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:]
    return np.unique(packed[symbols[1:-1] != 0], return_counts=True)


@dataclass
class Encoder:
    """Text vectors; keeps the vectors of trigrams seen."""

    dimensions: int = DIMENSIONS
    seed: int = SEED
    letter: dict[int, np.ndarray] = field(default_factory=dict)
    row: dict[int, int] = field(default_factory=dict)
    matrix: np.ndarray | None = None

    def letter_vector(self, point: int) -> np.ndarray:
        if point not in self.letter:
            draw = np.random.Generator(np.random.PCG64([self.seed, point]))
            self.letter[point] = (draw.integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.letter[point]

    def trigram_vector(self, packed: int) -> np.ndarray:
        a, b, c = (self.letter_vector(packed >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        return np.roll(a, 2) * np.roll(b, 1) * c

    def rows(self, packed: np.ndarray) -> np.ndarray:
        """Row of each trigram in the matrix, which grows as trigrams turn up."""
        found = [self.row.get(p, -1) for p in packed.tolist()]
        if -1 in found:
            if len(self.row) > KEPT_TRIGRAMS:
                self.row, self.matrix = {}, None
            if self.matrix is None:
                self.matrix = np.zeros((1024, self.dimensions), np.int8)
            for p in packed.tolist():
                if p not in self.row:
                    if len(self.row) == len(self.matrix):
                        self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                    self.matrix[len(self.row)] = self.trigram_vector(p)
                    self.row[p] = len(self.row)
            found = [self.row[p] for p in packed.tolist()]
        return np.asarray(found)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the text's trigram vectors; None without letters."""
        if not text:
            return None
        packed, counts = trigrams(text)
        if not len(packed):
            return None
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(packed), 4096):
            rows = self.rows(packed[at:at + 4096])
            total += counts[at:at + 4096].astype(np.float32) @ self.matrix[rows].astype(np.float32)
        return total


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = 2000) -> dict[str, list[int]]:
    """Prototypes by language, from about `rows_per_language` rows each (all rows of a rarer language).

    The languages are a small set of labels: their counts and prototypes pass the driver.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(draw < F.element_at(rates, F.col("lang"))).select("lang", "text").repartition(16)

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if (vector := encoder.bundle(text)) is not None and (norm := np.linalg.norm(vector)):
                    sums[lang] = sums.get(lang, 0) + np.rint(vector / norm * 1e6).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = sample.mapInPandas(bundled, "lang string, vector array<long>")
    totals = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r["lang"]: [x["x"] for x in r["v"]] for r in found}


def predict(text: Column, prototypes: dict[str, list[int]]) -> Column:
    """struct(lang_pred, score, margin) of a text column; margin is the lead over the second language."""
    names = sorted(prototypes)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        known = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)
        if names:
            known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
        for texts in batches:
            out = []
            for text in texts:
                vector = encoder.bundle(text) if names else None
                norm = 0.0 if vector is None else float(np.linalg.norm(vector))
                if not norm:
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                cosines = known @ (vector.astype(np.float64) / norm)
                best = int(np.argmax(cosines))
                second = float(np.partition(cosines, -2)[-2]) if len(names) > 1 else 0.0
                out.append((names[best], min(1.0, max(0.0, float(cosines[best]))), float(cosines[best]) - second))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "margin"])

    return judge(text)
