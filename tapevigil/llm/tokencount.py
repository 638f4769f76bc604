"""Token counts of a unigram model by dynamic programming over a shared trie.

The vocabulary file gives pieces and ranks; a piece's unigram score is its
rank's Zipf log-probability, -log(rank + 1). A pre-token's count is the number
of pieces in its best segmentation: highest sum of scores, then fewest pieces.

Each task puts the distinct pre-tokens of its texts in a trie. The forward score
of a node depends on its prefix only, so it is computed once for all pre-tokens
that share it; the count at a pre-token's last node is stored. The trie is
emptied when it has `MAX_NODES` nodes, and prefixes longer than `MAX_DEPTH`
bytes are scored without nodes: this bounds memory and changes no result.

Defined results: a null or empty text has 0 pre-tokens and 0 tokens; a byte in
no piece counts as one token of its own with the score of a rank past the last.
No other column is read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tapevigil.llm.bpe import parse_ranks, rank_file

MAX_NODES = 1_000_000
MAX_DEPTH = 256


class PrefixScores:
    """Forward scores and token counts of pre-tokens, shared by prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.score = {piece: -math.log(rank + 1) for piece, rank in ranks.items()}
        self.unknown = -math.log(len(ranks) + 1) - 1
        # All ends of pieces: a stretch that is none of them can't grow to the left into a piece.
        self.ends = {piece[i:] for piece in self.score for i in range(len(piece))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [(0.0, 0)]
        self.terminal: dict[str, int] = {}

    def step(self, raw: bytes, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -pieces) of raw[:end], given those of all shorter prefixes."""
        one = path[end - 1]
        found = (one[0] + self.score.get(raw[end - 1:end], self.unknown), one[1] - 1)
        start = end - 2
        while start >= 0 and (stretch := raw[start:end]) in self.ends:
            if (score := self.score.get(stretch)) is not None:
                before = path[start]
                found = max(found, (before[0] + score, before[1] - 1))
            start -= 1
        return found

    def count(self, token: str) -> int:
        if (known := self.terminal.get(token)) is not None:
            return known
        if len(self.best) > MAX_NODES:
            self.clear()
        raw, node, path = token.encode("utf-8", "surrogatepass"), 0, [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            if end > MAX_DEPTH:
                path.append(self.step(raw, end, path))
                continue
            edge = node << 8 | raw[end - 1]
            node = self.child.get(edge, 0)
            if not node:
                node = self.child[edge] = len(self.best)
                self.best.append(self.step(raw, end, path))
            path.append(self.best[node])
        if len(raw) <= MAX_DEPTH:
            self.terminal[token] = -path[-1][1]
        return -path[-1][1]


def counts(spark: SparkSession, text: Column, ranks: str, pattern: str) -> Column:
    """struct(n_tokens, n_pretokens) of a text column."""
    shared = spark.sparkContext.broadcast(rank_file(ranks))

    @F.pandas_udf("n_tokens long, n_pretokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        split, model = regex.compile(pattern).findall, PrefixScores(parse_ranks(shared.value))
        for texts in batches:
            rows = []
            for t in texts:
                tokens = split(t) if t else ()
                rows.append((sum(map(model.count, tokens)), len(tokens)))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_pretokens"], dtype="int64")

    return count(text)
