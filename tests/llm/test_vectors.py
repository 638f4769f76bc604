"""Embedding dedup and Hamming search against plain versions."""

import math
import random

import numpy as np
from brute import embeddings as plain_embeddings
from pyspark.sql import functions as F

from tapevigil.llm import embdedup, graph, hamming


def clusters(seed, dims=64):
    rng = np.random.default_rng(seed)
    rows, nxt = [], 0
    for label in (1, 2):
        for _ in range(8):
            centre = rng.standard_normal(dims)
            for _ in range(12):
                rows.append((nxt, (centre + rng.standard_normal(dims) * rng.uniform(0.05, 0.4)).astype(np.float32).tolist(), label))
                nxt += 1
    vector = rows[3][1]
    rows += [(1000 + i, vector, 1) for i in range(4)] + [(1010, vector, 2), (1011, vector, None), (1012, None, 1), (1013, [], 1)]
    rows += [(1014, [0.0] * dims, 1), (1015, [math.nan] + vector[1:], 1), (1016, [math.inf] + vector[1:], 1), (1017, [None] + vector[1:], 1)]
    rows += [(1018, [x * 3 for x in vector], 1), (1019, vector[:32], 1), (1020, vector[:32], 1), (1000, vector, 1)]
    return rows


def table(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, cls string, size string, key string, id string"
    return spark.createDataFrame([(*r, "c", "s", "k", "i") for r in rows], schema).repartition(3)


def test_embedding_links_match_plain_version(spark):
    rows = clusters(1)
    got = sorted(map(tuple, embdedup.linked(table(spark, rows)).collect()))
    want = sorted(plain_embeddings(rows))
    assert [g for g in got if g[0] != 1000] == [w for w in want if w[0] != 1000]
    assert embdedup.linked(table(spark, [])).count() == 0


def test_table_count_meets_recall():
    for largest in (10, 5_000, 1 << 40):
        bits, count = embdedup.tables(largest, 0.93, 0.999)
        assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** count >= 0.999


def test_hamming_search_is_exact(spark):
    rng = random.Random(4)
    codes = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(300)]
    codes += [(1000 + i, codes[7][1] ^ (1 << rng.randrange(63))) for i in range(30)] + [(2000 + i, codes[7][1]) for i in range(40)]
    codes += [(3000, None), (None, 5), (7, codes[7][1])]
    rows = spark.createDataFrame([(*c, "v", 1) for c in codes], "id long, code long, v string, q int")
    asked = rows.filter("id % 50 = 0 OR id = 7")
    got = {}
    for r in hamming.search(rows, asked, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["distance"], r["id"]))
    known = {(i, c) for i, c in codes if i is not None and c is not None}
    for query, code in {(i, c) for i, c in known if i % 50 == 0 or i == 7}:
        near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in known if i != query)[:5]
        assert sorted(got[query]) == [(k + 1, n // 10**6, n % 10**6) for k, n in enumerate(near)]
    few = rows.filter("id < 4")
    assert hamming.search(few, few, 10).count() == 12
    assert hamming.search(rows.limit(0), asked.limit(0), 10).count() == 0


def test_sign_codes(spark):
    rows = [([1.0] * 64,), ([-1.0] * 63 + [0.5],), ([1.0] * 63,), (None,), ([None] + [1.0] * 63,), ([float("nan")] * 64,)]
    got = [r[0] for r in spark.createDataFrame(rows, "e array<float>").select(hamming.sign_code(F.col("e"))).collect()]
    assert got == [-1, 1, None, None, None, None]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (9, 9)], "a long, b long").repartition(4)
    got = dict(map(tuple, graph.components(links).collect()))
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
