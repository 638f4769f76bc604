"""Age cohorts and near-duplicate shares against plain versions, in groups that are cut by rows."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tapevigil.operators import social
from tapevigil.operators.series import running_by_rows

POSTS = "post_id long, author_id string, text string, ts_ms long, ticker string, eval_ms long, author_age_days double"


def posts(spark, rows):
    """rows: (ticker, author, text, age)."""
    return spark.createDataFrame([(i, a, t, i, k, 0, age) for i, (k, a, t, age) in enumerate(rows)], POSTS).repartition(3)


def plain_cohort(ages, need=4):
    best = None
    for a in sorted(set(ages)):
        members = [x for x in ages if x >= a and x - a <= max(3.0, a * 0.35)]
        if best is None or len(members) > len(best):
            best = members
    if best is None or len(best) < need:
        return None
    mean = sum(best) / len(best)
    sd = math.sqrt(sum((x - mean) ** 2 for x in best) / len(best))
    return len(best), min(best), max(best), 0.0 if mean <= 0 else sd / mean


def test_age_cohorts_equal_plain_sweep(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        pool = [rng.choice([0.0, 3.0, 6.0, 10.0, 13.5, 20.0, 27.0, round(rng.uniform(0, 31), 1), rng.uniform(0, 40)]) for _ in range(rng.randrange(1, 60))]
        rows += [(None if k == 0 else f"t{k}", f"a{i}", "x", rng.choice([age, None]) if i % 9 == 0 else age) for i, age in enumerate(pool)]
    want = defaultdict(list)
    for k, _, _, age in rows:
        if age is not None and age <= 30:
            want[k].append(age)
    want = {k: c for k, v in want.items() if (c := plain_cohort(v))}
    for chunk in (7, 16_384):
        got = {r["ticker"]: (r["cohort_size"], r["age_lo"], r["age_hi"], r["cohort_cv"]) for r in social.age_cohorts(posts(spark, rows), chunk_rows=chunk).collect()}
        assert got.keys() == want.keys()
        for k, c in want.items():
            assert got[k][:3] == c[:3] and math.isclose(got[k][3], c[3], abs_tol=1e-7)
    assert social.age_cohorts(posts(spark, rows).limit(0)).count() == 0


def test_running_totals_by_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(10), i, rng.randrange(5)) for i in range(600)]
    got = running_by_rows(spark.createDataFrame(rows, "k string, x long, id long, v long").repartition(4), ["k"], ["x", "id"], {"s": F.col("v"), "c": F.lit(1)}, 16).collect()
    upto = defaultdict(lambda: [0, 0])
    want = []
    for k, x, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        upto[k][0] += v
        upto[k][1] += 1
        want.append((k, x, i, v, *upto[k]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def shingles(text):
    words = text.lower().split()
    return frozenset(words) if len(words) < 3 else frozenset(" ".join(words[i:i + 3]) for i in range(len(words) - 2))


def plain_share(texts):
    count = Counter(shingles(t) for t in texts)
    same = sum(n * (n - 1) / 2 for n in count.values())
    sets = list(count)
    for i, a in enumerate(sets):
        same += sum(count[a] * count[b] for b in sets[:i] if len(a & b) >= 0.6 * len(a | b) - 1e-9)
    n = len(texts)
    return same / (n * (n - 1) / 2) if n >= 3 else 0.0


def cluster(rng, n, words):
    base = [rng.choice(words) for _ in range(rng.randrange(2, 25))]
    for _ in range(n):
        changed = list(base)
        for _ in range(rng.randrange(0, 4)):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        yield " ".join(changed)


def test_duplicate_share_equals_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    rows = [(k, "a", t, 1.0) for k in ("x", "y", None) for _ in range(12) for t in cluster(rng, rng.randrange(1, 25), words)]
    rows += [("z", "a", t, 1.0) for t in cluster(rng, 400, words)]  # more than a cell, all alike
    rows += [("one", "a", "w1 w2", 1.0)] + [("same", "a", "w1 w2 w3 w4", 1.0)] * 5
    got = {r["ticker"]: r["duplicate_ratio"] for r in social.duplicate_ratio(posts(spark, rows)).collect()}
    texts = defaultdict(list)
    for k, _, t, _ in rows:
        texts[k].append(t)
    assert got.keys() == texts.keys()
    for k, own in texts.items():
        assert math.isclose(got[k], plain_share(own), abs_tol=1e-9), k


def test_work_grows_with_the_posts(spark):
    """Rows of the index, and pairs that its cells compare, for ten times as many different posts."""
    compared = []
    for size in (1_000, 10_000):
        rng = random.Random(size)
        words = [f"w{i}" for i in range(size)]
        rows = [("hot", "a", " ".join(rng.choice(words) for _ in range(20)) + " buy now before it moves", 1.0) for _ in range(size)]
        table = posts(spark, rows).select("ticker", "eval_ms", F.array_sort(F.transform(social.fingerprint(F.col("text")), lambda s: F.xxhash64(s))).alias("prints"))
        index = social.prefix_index(table.withColumns({"n": F.lit(1), "cls": F.monotonically_increasing_id()}), 0.6)
        met = index.groupBy("token").count()
        compared.append(met.agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0])
    assert compared[1] <= 30 * max(compared[0], 100)


def counted_prints(spark, rows):
    """The fingerprints of rows as duplicate_ratio counts them, all of them different, as a written table."""
    prints = F.sort_array(F.transform(social.fingerprint(F.col("text")), lambda s: F.xxhash64(s)))
    table = posts(spark, rows).select("ticker", "eval_ms", prints.alias("prints"))
    return social.settle(table.withColumns({"n": F.lit(1), "cls": F.monotonically_increasing_id(), "anchor": F.get("prints", F.lit(0))}))


def test_fingerprints_are_read_once_for_each_cell(spark):
    """Near copies share most of their shingles; they meet once, and the index carries no fingerprints."""
    rng = random.Random(8)
    rows = []
    for c in range(10):
        base = [f"c{c}w{i}" for i in range(200)]
        for v in range(12):
            changed = list(base)
            changed[rng.randrange(200)] = f"x{c}_{v}"
            rows.append(("hot", "a", " ".join(changed), 1.0))
    counted = counted_prints(spark, rows)
    index = social.prefix_index(counted, 0.6)
    assert not any(t.startswith("array") for _, t in index.dtypes)
    index = social.settle(index.join(social.blocks_of(counted), "cls"))
    assert index.count() >= 20 * len(rows)
    assert social.meetings(index, 0.6).count() == len(rows)  # all in one block of the group
    got = social.duplicate_ratio(posts(spark, rows)).first()["duplicate_ratio"]
    assert math.isclose(got, plain_share([t for _, _, t, _ in rows]), abs_tol=1e-9) and got > 0


def test_duplicate_share_across_blocks(spark, monkeypatch):
    """Each pair is counted once, whichever blocks its posts are in; texts without words count for nothing."""
    from tapevigil.operators import cells

    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(k, "a", t, 1.0) for k in ("x", None) for _ in range(25) for t in cluster(rng, rng.randrange(1, 20), words)]
    wordless = [(None, "a", "", 1.0), ("x", "a", "?! ...", 1.0), ("bare", "a", "\u00e9", 1.0)]
    texts = defaultdict(list)
    for k, _, t, _ in rows:
        texts[k].append(t)
    for block in (2, 7, 128):
        monkeypatch.setattr(cells.blocked, "__defaults__", (block,))
        got = {r["ticker"]: r["duplicate_ratio"] for r in social.duplicate_ratio(posts(spark, rows + wordless)).collect()}
        assert got.pop("bare") == 0.0 and got.keys() == texts.keys()
        for k, own in texts.items():
            assert math.isclose(got[k], plain_share(own), abs_tol=1e-9), (k, block)


def test_fingerprint_of_a_long_text(spark):
    """Shingles cost the same in a long text as in a short one: no copy of all words for each."""
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(0, long), (1, "One two,three"), (2, "a b"), (3, "a a"), (4, ""), (5, "?! ..."), (6, "a b c a b c a")], "id int, text string")
    prints = df.select("id", social.fingerprint(F.col("text")).alias("f"))
    assert "slice(" not in prints._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["f"] for r in prints.where("id > 0").collect()}
    assert got == {1: ["one two three"], 2: ["a", "b"], 3: ["a"], 4: [], 5: [], 6: ["a b c", "b c a", "c a b"]}
    assert prints.where("id = 0").select(F.size("f"), F.get("f", F.lit(29_997))).first()[:] == (29_998, "w29997 w29998 w29999")
