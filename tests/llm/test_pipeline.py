"""The pipeline, stage by stage, against plain versions, and its entry."""

import hashlib
import os
import random
import sys

import duckdb
import public_tokenizers
from brute import jaccard as plain_jaccard
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from tapevigil.llm import bpe, langid, linededup, mixing  # noqa: E402
from tapevigil.llm.common import stored  # noqa: E402


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf))
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    (start, told), (_, lined), (_, alone), (_, mixed) = kept
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    model = langid.fit(start.filter("doc_id IS NOT NULL"))
    judged = {r["doc_id"]: r["p"] for r in start.select("doc_id", langid.predict(F.col("text"), model).alias("p")).collect()}
    letters = {i: sum(c.isalpha() for c in t or "") for i, t in texts.items()}
    assert {r["doc_id"] for r in told.collect()} == {
        i for i in texts if letters[i] and judged[i]["score"] >= 0.15 * min(1, letters[i] / 100)}
    told.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {i: (n, digest) for i, _, n, digest in con.execute(linededup.SQL).fetchall()}
    for r in lined.collect():
        left, lines = iter(texts[r["doc_id"]].split("\n")), r["text"].split("\n")
        assert r["text"] == "" or all(line in left for line in lines)
        assert r["n_chars"] == len(r["text"]) and hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][1]
    assert len(want) == lined.count() and sum(n for n, _ in want.values()) > 0
    rows = [(r["doc_id"], r["text"]) for r in lined.collect()]
    wordless = {i for i, t in rows if not t.split()}
    assert {r["doc_id"] for r in alone.collect()} == {c for _, c, _ in plain_jaccard(rows)} | wordless
    sizes = mixing.sized(alone)
    times = {r["doc_id"]: r["times"] for r in mixing.take(sizes, mixing.plan(sizes)).collect()}
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {i: n for i, n in times.items() if n}
    codec = bpe.encoding(bpe.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    by_id = dict((r["doc_id"], r["text"]) for r in mixed.collect())
    for r in pipeline.STAGES[-1][1](spark, mixed, sf).collect():
        assert r["n_tokens"] == len(codec.encode_ordinary(by_id[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_pass_all_stages(spark, sf):
    rows = [(None, None, None, None, None, 1.0), (1, "", "en", "a", 0, None), (2, "some words that are here", None, None, 24, 2.0), (2, "some words that are here", None, None, 24, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row double")
    for table in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            table = stored(stage(spark, table, sf))
        assert table.count() <= 3


def test_texts_like_no_language_go(spark, sf):
    rng = random.Random(1)
    junk = [(10**6 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(400))) for i in range(200)]
    junk += [(2 * 10**6 + i, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400))) for i in range(200)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.createDataFrame([(i, t, None, None, 400) for i, t in junk], "doc_id long, text string, lang string, source string, n_chars long")
    left = [r["doc_id"] for r in pipeline.language(spark, docs.unionByName(rows), sf).select("doc_id").collect()]
    assert sum(i >= 10**6 for i in left) <= 20 and sum(i < 10**6 for i in left) >= 0.97 * docs.count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] and "pipeline" in names
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert {"op2_line_dedup", "op7_hamming_search", "op10_source_mix"} <= entry.oracle_sql().keys()
