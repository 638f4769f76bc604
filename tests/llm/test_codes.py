"""Vector codes against a plain version."""

import hashlib
import math
import random

import numpy as np

from tapevigil.llm import codes


def plain(rows, parts=8, entries=16, rounds=6):
    """(id, label, code, error) of kept rows and the codebooks, by Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-longest // parts))
    top = codes.limit(1 << max(0, width - 1).bit_length())
    ints = [[max(-top, min(top, math.floor(4096 * x))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in ints]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[near(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [v[p] for v, c in zip(cut, chosen) if c[p] == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for row, v in zip(kept, cut):
        found = [near(p, v[p]) for p in range(parts)]
        out.append((row[0], row[2], bytes(e for _, e in found), sum(d for d, _ in found)))
    return out, books


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code string, part int, error int").repartition(3)


def vectors(seed, dims, n=300):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice((1, 2, None))) for i in range(n)]
    same = rows[5][1]
    rows += [(1000 + i, same, 1) for i in range(20)] + [(2, same, 2), (None, same, None), (1100, None, 1), (1101, same[:-1] + [math.nan], 1)]
    rows += [(1102, same[:-1] + [math.inf], 1), (1103, same[:-1] + [None], 1), (1104, [0.0] * dims, 3), (1105, [1e300] * dims, 3), (1106, [-1e9] * dims, 4)]
    rng.shuffle(rows)
    return rows


def compare(spark, rows):
    found, books = codes.coded(table(spark, rows))
    want, plain_books = plain(rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert books.tolist() == plain_books or not want
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    got = codes.with_label_error(found).collect()
    assert len(got) == len(want) and all(r["label_error"] == (sums[r["label"]] if sums[r["label"]] < 2**63 else None) for r in got)
    return books


def test_codes_match_plain_version(spark):
    books = compare(spark, vectors(1, 64))
    assert codes.digest(books) == hashlib.sha256(",".join(str(x) for b in books.tolist() for e in b for x in e).encode()).hexdigest()


def test_other_widths_and_few_rows(spark):
    compare(spark, vectors(2, 24, 60))  # parts of three components
    compare(spark, vectors(3, 8, 40))  # one component a part
    compare(spark, [(i, [0.1 * j for j in range(i * 5)], 1) for i in range(9)])  # several lengths, an empty vector
    compare(spark, [(1, [1.0] * 16, None)] * 3)


def test_no_rows_are_left(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 8, 2)]):
        found, books = codes.coded(table(spark, rows))
        assert codes.with_label_error(found).count() == 0 and books.size == 0


def test_transform_keeps_distances():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 8, 13, 32):
        a, b = rng.integers(-5000, 5000, (40, width)), rng.integers(-5000, 5000, (9, width))
        b[3] = b[7]
        a[5] = b[7]
        plain_squares = ((a[:, None] - b[None]) ** 2).sum(2)
        entry, squares = codes.nearest(codes.transformed(a), codes.transformed(b))
        assert (entry == plain_squares.argmin(1)).all() and (squares == plain_squares.min(1)).all()


def test_coefficients_come_in_sequency_order():
    functions = codes.butterflies(np.eye(16, dtype=np.int64)).T[codes.sequency_order(16)]
    assert (functions[:, 1:] != functions[:, :-1]).sum(axis=1).tolist() == list(range(16))
