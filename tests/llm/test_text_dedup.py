"""Line, substring and n-gram dedup against plain versions."""

import hashlib
import random

from brute import jaccard as plain_jaccard
from brute import substring as plain_substring
from pyspark.sql import functions as F

from tapevigil.llm import jaccard, linededup, substring

SCHEMA = "doc_id long, text string, row string, size long, d string, kept string, anchor int"


def docs(spark, rows):
    """Documents with further columns, named like the operators' own."""
    return spark.createDataFrame([(i, t, "r", 7, "x", "k", 1) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


def near_copies(rng):
    """Unrelated texts, copies, near copies, shared passages, short, empty, null and very long texts."""
    passage, base = prose(rng, 60), prose(rng, 300)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 200)))) for i in range(30)]
    rows += [(100 + i, " ".join(prose(rng, 20) + passage + prose(rng, 20))) for i in range(12)]
    for i in range(25):
        changed = list(base)
        for _ in range(rng.randrange(0, 9)):
            changed[rng.randrange(len(base))] = f"new{rng.random()}"
        rows.append((200 + i, " ".join(changed)))
    rows += [(300 + i, " ".join(base)) for i in range(5)] + [(300, " ".join(base))] * 3
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "one  two\n"), (None, "one two"), (None, None), (405, "a a a a a " * 40)]
    rows += [(500, " ".join(prose(rng, 20_000))), (501, "x" * 200_000), (502, "\u00a0z\u2003y " * 50)]
    return rows


def test_substring_matches_plain_version(spark):
    rows = near_copies(random.Random(5))
    out = substring.deduplicated(docs(spark, rows)).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h"))
    got = sorted(map(tuple, out.collect()), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain_substring([t for _, t in rows], substring.WINDOW))), key=str)
    assert got == want and sum(w[2] for w in want) > 1000


def test_substring_spans_and_small_windows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    out = substring.deduplicated(docs(spark, rows), window=7, seed=3)
    got = {r["doc_id"]: r for r in out.select("row.doc_id", "n_words", "n_removed", "kept", "repeats").collect()}
    for (i, t), (n, gone, digest) in zip(rows, plain_substring([t for _, t in rows], 7)):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (n, gone) and hashlib.sha256(got[i]["kept"].encode()).hexdigest() == digest
        assert sum(b - a for a, b in got[i]["repeats"]) == gone and all(b - a >= 7 for a, b in got[i]["repeats"])


def test_jaccard_matches_plain_version(spark):
    rows = near_copies(random.Random(6))
    got = jaccard.joined(docs(spark, rows)).select("id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_jaccard(rows), key=str)


def test_jaccard_keeps_one_row_of_each_group(spark):
    rows = near_copies(random.Random(7))
    table = docs(spark, rows)
    left = jaccard.distinct_documents(table)
    assert left.columns == table.columns
    got = sorted((r["doc_id"] for r in left.collect()), key=str)
    classes = plain_jaccard(rows)
    wordless = [i for i, t in rows if not (t or "").split()]
    assert set(got) == {c for _, c, _ in classes} | set(wordless)
    assert len(got) == len(set(got) - {None}) + got.count(None)


def test_jaccard_large_group_is_dealt_into_cells(spark):
    rng, base = random.Random(9), prose(random.Random(1), 100)
    rows = []
    for i in range(300):
        changed = list(base)
        changed[rng.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(changed)))
    got = jaccard.joined(docs(spark, rows)).select("id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(plain_jaccard(rows))


def test_line_templates_generalise_and_leave_one_home(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        own = " ".join(prose(rng, 30))
        lines = [own, f"Posted by user{i} on the board {rng.randrange(99)} times", "See all of our terms"]
        rows.append((i, "\n".join(lines)))
    rows += [(900 + i, "a whole copied text\nwith two lines in it") for i in range(30)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, "See all of our terms"), (53, "See all of our terms\nSee all of our terms"), (54, "very long " * 30_000)]
    out = linededup.deduplicated(docs(spark, rows)).select("row.doc_id", "n_lines", "n_removed", "kept")
    got = {r["doc_id"]: r for r in out.collect()}
    texts = dict(rows)
    assert got[None]["n_removed"] == 0 and got[53]["kept"] == "" and got[53]["n_removed"] == 2
    assert got[0]["n_removed"] == 1 and "Posted" in got[0]["kept"]  # home of one template
    for i in range(1, 40):
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["kept"]) == (3, 2, texts[i].split("\n")[0])
    for i in (*range(900, 930), 51, 52, 54):
        assert got[i]["kept"] == texts[i] and got[i]["n_removed"] == 0
    assert got[50]["kept"] is None and got[50]["n_lines"] == 0 and got[51]["n_lines"] == 1


def test_empty_tables(spark):
    none = docs(spark, [])
    assert substring.deduplicated(none).count() == 0
    assert jaccard.joined(none).count() == 0
    assert jaccard.distinct_documents(none).count() == 0
    assert linededup.deduplicated(none).count() == 0


def test_rarely_changed_parts():
    assert jaccard.longest_prefix(0.8, 0.9995, 20) == 5
    assert 1 - (1 - 0.8**5) ** 20 >= 0.9995


def test_texts_with_one_32_bit_hash_are_told_apart(spark):
    a, b = (" ".join(f"w{k}x{i}" for k in range(40)) for i in (94274, 248532))
    rows = [(None, a), (None, b), (1, a)]
    table = docs(spark, rows)
    assert table.select(F.hash("text")).distinct().count() == 1
    out = substring.deduplicated(table).select("row.doc_id", "row.text", "n_removed", "kept").collect()
    assert {(r["text"], r["n_removed"], r["kept"]) for r in out} == {(a, 40, ""), (b, 0, b)}
    assert sorted(r["text"] for r in jaccard.distinct_documents(table).collect()) == sorted([a, b])
    notes = [(i, f"own{i}\nSee all of our terms") for i in range(20)]
    lined = linededup.deduplicated(docs(spark, [*rows, *notes])).select("row.doc_id", "row.text", "kept").collect()
    assert all(r["kept"] == r["text"] for r in lined if r["text"] in (a, b))


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "c"), (None, " ", "d"), (None, " ", "e"), (None, "one", "f"), (None, "one", "g")]
    left = jaccard.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted(r["source"] for r in left.collect())
    assert got[:5] == list("abcde") and len(got) == 6


def test_word_fields_do_not_split_templates_at_any_size(spark):
    days, months = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(), "January February March April May June July August September October November December".split()
    names = [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    for size in (40, 150, 400, 800, 2000):
        rng = random.Random(size)
        rows = []
        for i in range(size):
            lines = [f"own{i}", f"Last updated on {rng.choice(days)} in {rng.choice(months)} by staff"]
            lines += [f"Articles written by {rng.choice(names)} for the section {rng.choice(names)} of this paper"]
            rows.append((i, "\n".join(lines)))
        out = linededup.deduplicated(docs(spark, rows)).select("n_removed", "kept").collect()
        for start in ("Last updated", "Articles written"):
            # Templates that recur keep a home each, so at most one in ten texts.
            assert sum(start in r["kept"] for r in out) <= 1 + size // 10
        assert all("own" in r["kept"] for r in out)


def test_lines_that_share_only_their_first_words_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = [(i, f"own{i}\nHe said that {' '.join(word() for _ in range(1 + i % 6))}") for i in range(600)]
    out = linededup.deduplicated(docs(spark, rows)).select("n_removed").collect()
    assert all(r["n_removed"] == 0 for r in out)


def test_templates_of_one_leaf_keep_a_home_each(spark):
    rows = [(i, f"own{i}\nClick here to {'read' if i % 3 else 'send'} the {'story' if i % 3 else 'letter'}") for i in range(90)]
    kept = [r["kept"] for r in linededup.deduplicated(docs(spark, rows)).select("kept").collect()]
    assert sorted(k.split("\n")[1] for k in kept if "\n" in k) == ["Click here to read the story", "Click here to send the letter"]


def test_short_lines_recur_like_the_rest(spark):
    rows = [(i, f"own{i}\n\nRead more\n{i}\nAdvertisement\nPage {i}\n \nRead on{'' if i else ' once'}") for i in range(30)]
    rows += [(100 + i, f"other{i}\nSeldom seen") for i in range(9)]
    got = {r["doc_id"]: r for r in linededup.deduplicated(docs(spark, rows)).select("row.doc_id", "n_removed", "kept").collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 3 and got[1]["kept"].endswith("Read on")
    for i in range(2, 30):
        assert (got[i]["n_removed"], got[i]["kept"]) == (4, f"own{i}\n\n{i}\n ")
    for i in range(100, 109):
        assert got[i]["n_removed"] == 0


def test_line_query_equals_its_sql(spark, tmp_path):
    """The registered query and its SQL on word fields, short lines, copies, missing and repeated ids, empty and odd texts."""
    import duckdb

    from tapevigil.llm.queries import ORACLES, QUERIES

    rng = random.Random(12)
    days = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
    rows = []
    for i in range(300):
        lines = [f"own{i}", f"Last updated on {rng.choice(days)} in {rng.choice(days)} by staff", rng.choice(["Read more", "Page  7\t", f"Page {i}", "", " \r", "a"])]
        lines += [f"He said that {rng.choice(days)} {i}x {rng.choice(days)}", " ".join(rng.choice(days) for _ in range(rng.randrange(1, 7)))]
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(lines)))
    rows += rows[:20] + [(900, None), (901, ""), (902, "\n\n"), (None, None), (903, "very long " * 20_000), (None, "Read more"), (7, "Read more"), (7, "Read more\nRead more")]
    docs(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op2_line_dedup"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 500


def test_repeated_rows_have_their_spans_once(spark):
    """Many rows of one text without ids: the spans of a row do not grow with the number of rows."""
    text = " ".join(prose(random.Random(3), 600, 100_000))
    table = docs(spark, [(None, text)] * 400 + [(1, text + " more"), (2, "short")])
    spans = substring.repeats(substring.keyed(table, "doc_id", "text"), substring.WINDOW, substring.SEED)
    assert spans.agg(F.max(F.size("spans"))).first()[0] < 600
    out = substring.deduplicated(table).select("row.doc_id", "n_words", "n_removed").distinct().collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 600, 600), (1, 601, 600), (2, 1, 0)], key=str)
