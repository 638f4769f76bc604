"""Lexical search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np

from tapevigil.llm import ranking

TERM = re.compile(ranking.PATTERN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=ranking.TOP):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, bag, n in bags:
            m, score = 10 + 90 * n * n_docs // n_terms, 0
            for t in asked & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for i in range(120) for c in ("w", "É", "Zz")]
    prose = lambda n: " ".join(rng.choice(vocabulary[:rng.choice((20, 360))]) for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 60))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[3][1]), (None, docs[3][1])]
    docs += [(600, None), (601, ""), (602, " -- \n"), (603, "w1"), (604, "W1, w1; wÉ1"), (605, prose(30_000)), (606, "\x00w1\x7f" * 3)]
    shared = prose(15)
    items = [(i, shared + " " + prose(rng.randrange(0, 25))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nosuchword"), (103, "w1"), (103, "w1"), (103, "w2"), (None, "w3 w4"), (104, docs[3][1])]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, item string, n int, score int").repartition(5),
            spark.createDataFrame([(*i, "y", 3) for i in items], "item_id long, text string, query string, rank int").repartition(2))


def got(found):
    return sorted((tuple(r) for r in found.select("item", "rank", "id", "score").collect()), key=str)


def test_search_matches_plain_version(spark):
    docs, items = tables(1)
    want = plain(docs, items)
    d, i = frames(spark, docs, items)
    assert got(ranking.search(d, i)) == want and len(want) > 300
    # Several blocks of queries, one of them a single query that is too large for a block.
    assert got(ranking.search(d, i, block_terms=25)) == want
    assert got(ranking.search(d, i, top=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = tables(2)
    d, i = frames(spark, docs, items)
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.filter("doc_id = 601"), i), (d, i.filter("item_id = 102"))):
        assert got(ranking.search(x, y)) == []


def test_shared_sets_are_summed_once():
    rng = random.Random(4)
    for _ in range(20):
        core = [rng.sample(range(60), 12) for _ in range(3)]
        queries = [sorted({*rng.choice(core), *rng.sample(range(60), 5)}) for _ in range(40)]
        graph = ranking.Sharing(queries, 60)
        cells = np.zeros((graph.nodes, 7), np.int64)
        cells[:60] = np.arange(420).reshape(60, 7) ** 3
        leaves = cells[:60].copy()
        assert (graph.scores(cells) == [leaves[q].sum(axis=0) for q in queries]).all()
        # Fewer sums than without sharing, and no pair left that two queries have.
        assert graph.nodes - 60 + len(graph.flat) < sum(map(len, queries)) / 2
        ends = [*graph.starts[1:], len(graph.flat)]
        assert not graph.common([graph.flat[a:b].tolist() for a, b in zip(graph.starts, ends)], 64)


def test_long_texts_are_split_at_spaces(monkeypatch):
    text = ("Ab-c é1 " * 50 + "x" * 300 + " end").encode()
    whole = [t for part in ranking.terms(text) for t in part]
    monkeypatch.setattr(ranking, "SPLIT_BYTES", 16)
    assert [t for part in ranking.terms(text) for t in part] == whole == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]
