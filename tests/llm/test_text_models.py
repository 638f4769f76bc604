"""Language ID, token ids and counts, URL filter and source mix."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
from brute import unigram
from pyspark.sql import functions as F

from tapevigil.llm import bpe, langid, mixing, queries, tokencount, urlfilter

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "\n\n  \t", "Hello's world 123", "été 😀 naïve  x", "a" * 3000, "1 2\u00a0 3\u2003x  y\n\n z ", "word " * 60_000,
    "🦀" * 500, "<|endoftext|> it'll", "Hello's world 123",
]


def table(spark, texts=TEXTS):
    rows = [(i if t is not None else None, t, "en", "s", 1, "i") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, ids string").repartition(2)


def test_ids_are_the_librarys_and_decode_to_the_text(spark):
    codec = bpe.encoding(bpe.rank_file(RANKS), PATTERN)
    docs = table(spark)
    ids = docs.select("text", bpe.encode(spark, F.col("text"), RANKS, PATTERN, 1000).alias("ids"))
    for r in ids.withColumn("raw", bpe.decode(spark, F.col("ids"), RANKS, PATTERN)).withColumn("n", bpe.token_count(F.col("ids"))).collect():
        want = codec.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n"] == len(want)
        assert bytes(r["raw"]) == (r["text"] or "").encode()
    both = docs.select("text", bpe.round_trip(spark, F.col("text"), RANKS, PATTERN, 1000).alias("t")).select("text", "t.*")
    for r in both.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == codec.encode_ordinary(r["text"] or "") and bytes(r["raw"]) == (r["text"] or "").encode()
    assert ids.limit(0).count() == 0


def test_pieces_keep_every_match_whole():
    text = "ab  cd\n e 12 it's !! \u00a0x " * 50
    split = regex.compile(PATTERN).findall
    for limit in (1, 5, 17):
        parts = list(bpe.pieces(text, limit))
        assert "".join(parts) == text and len(parts) > 20
        assert [m for p in parts for m in split(p)] == split(text)


def test_bytes_that_are_not_text_decode():
    codec = bpe.encoding(bpe.rank_file(RANKS), PATTERN)
    half = np.asarray(codec.encode_ordinary("é")[:1], "<u4").tobytes()
    assert bpe.decode_ids(codec, half) in ("é".encode(), "é".encode()[:1]) and bpe.decode_ids(codec, None) == b""


def test_token_counts_match_plain_segmentation(spark):
    docs = table(spark)
    got = docs.select("text", tokencount.counts(spark, F.col("text"), RANKS, PATTERN).alias("c")).select("text", "c.*").collect()
    model = tokencount.PrefixScores(bpe.parse_ranks(bpe.rank_file(RANKS)))
    for r in got:
        tokens = regex.findall(PATTERN, r["text"] or "")
        plain = {t: unigram(t.encode(), model.score, model.unknown) for t in set(tokens)}
        assert (r["n_pretokens"], r["n_tokens"]) == (len(tokens), sum(plain[t] for t in tokens))


def test_emptied_trie_gives_equal_counts(monkeypatch):
    ranks = bpe.parse_ranks(bpe.rank_file(RANKS))
    words = [" the", " there", " thereby", "xqzv", "ing", " the"] * 3
    whole = [tokencount.PrefixScores(ranks).count(w) for w in words]
    monkeypatch.setattr(tokencount, "MAX_NODES", 3)
    monkeypatch.setattr(tokencount, "MAX_DEPTH", 2)
    small = tokencount.PrefixScores(ranks)
    assert [small.count(w) for w in words] == whole


def test_language_accuracy_on_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    found = queries.QUERIES["op1_language_id"](spark, sf).join(docs, "doc_id").filter("held_out AND n > 20")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right / n > 0.98


def test_language_edges(spark):
    rows = [(1, "the cat and the dog " * 9, "en"), (2, "le chat et le chien " * 9, "fr"), (3, "und", None), (None, "x", "en"), (4, None, "en"), (5, "1 2 3", "en")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    texts = ["the dog", "LE CHIEN", "", None, "42 !", "漢字", "the cat and the dog " * 20_000]
    asked = spark.createDataFrame([(t, 0.5) for t in texts], "text string, score double")
    got = [tuple(r["p"])[:2] for r in asked.select(langid.predict(F.col("text"), model).alias("p")).collect()]
    assert [g[0] for g in got[:5]] == ["en", "fr", "und", "und", "und"] and got[6][0] == "en"
    assert all(0 <= s <= 1 for _, s in got)
    assert langid.fit(labelled) == model
    none = langid.fit(labelled.filter("lang = 'xx'"))
    assert [r[0] for r in asked.select(langid.predict(F.col("text"), none).getField("lang_pred")).collect()] == ["und"] * 7


def test_trigram_vectors_bind_permuted_letters():
    encoder = langid.Encoder(dimensions=64)
    a, b, c = (encoder.letter_vector(ord(x)) for x in "abc")
    packed, counts = langid.trigrams("abc")
    total = sum(n * encoder.trigram_vector(int(p)) for p, n in zip(packed, counts))
    edge = encoder.letter_vector(0)
    want = np.roll(edge, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * c + np.roll(b, 2) * np.roll(c, 1) * edge
    assert (total == want).all() and (encoder.bundle("abc") == want).all()


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/#y", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.net/esx/", "x.net", "/esx/", None, None), ("http://foo.com", "foo.com", "", None, None),
    ("x.com/en/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("a://b?c://d/e", "b", "", None, None),
])
def test_url_parts_and_rules(spark, url, host, path, rule, verdict):
    h, p = urlfilter.split_url(F.col("url"))
    rows = spark.createDataFrame([(url,)], "url string").select(h.alias("host"), p.alias("path"))
    r = rows.withColumn("fit", urlfilter.fitting_rule(F.col("host"), F.col("path"))).select("host", "path", "fit.*").first()
    assert tuple(r) == (host, path, rule, verdict)


def test_url_trees_learn_given_labels(spark):
    rng = np.random.default_rng(2)
    def url(i, bad):
        return f"http://s{i}.{'bad' if bad else 'fine'}.org/{'9' * int(rng.integers(8, 14)) if bad else 'page'}/{i}"
    kinds = rng.integers(0, 2, 400).tolist()
    labels = spark.createDataFrame([(url(i, k), k) for i, k in enumerate(kinds[:300])], "url string, label int")
    pages = [(i, url(i, k), "h") for i, k in enumerate(kinds)] + [(900, None, "h"), (901, "", "h"), (None, "http://x.fine.org/page/1", "h")] + [(902, "http://q.fine.org/" + "p" * 50_000, "h")] * 2
    rows = spark.createDataFrame(pages, "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(rows, "page_id", "url", labels=labels).collect()}
    right = sum((got[i]["verdict"] == "block") == bool(kinds[i]) for i in range(300, 400))
    assert right >= 97 and {got[i]["verdict"] for i in (900, 901)} <= {"allow", "block"} and len(got) == 404
    assert urlfilter.judge(rows.limit(0), "page_id", "url").count() == 0
    assert {r["verdict"] for r in urlfilter.judge(rows, "page_id", "url").collect()} == {"allow"}


def plain_rule(url, rules):
    """(host, path, rule, verdict) of a URL by string functions."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:ends[0]])
    path = rest[ends[0]:]
    path = path[:min([i for i, c in enumerate(path) if c in "?#"] + [len(path)])]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_url_filter_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = [(-1, None), (-2, "no host"), (-3, "HTTP://WWW.Example.COM/en/x?y#z"), (-4, "x://a.example.com/en/"), (-5, "http://b.NET/es/#"), (-5, "http://b.NET/es/#")]
    rows = pages.select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = urlfilter.judge(rows, "page_id", "url")
    urls = {r["page_id"]: r["url"] for r in rows.collect()}
    found = got.collect()
    assert len(found) == rows.count()
    for r in found:
        host, path, rule, verdict = plain_rule(urls[r["page_id"]], urlfilter.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    # Where no rule fits, the trees tell URLs apart.
    free = {r["verdict"] for r in found if r["rule"] is None}
    assert free == {"allow", "block"} and len({r["block_probability"] for r in found if r["rule"] is None}) > 10


def test_url_trees_on_hosts_that_they_have_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    held = F.pmod(F.xxhash64(F.lit(3), "host"), F.lit(4)) == 2
    known = urlfilter.judge(pages, "page_id", "url").where("rule IS NOT NULL").withColumn("held", held).join(pages, "page_id")
    labels = known.where("NOT held").select("url", (F.col("verdict") == "block").cast("int").alias("label"))
    got = urlfilter.judge(known.where("held").select("page_id", "url"), "page_id", "url", rules=(), labels=labels)
    right = got.select("page_id", F.col("verdict").alias("v")).join(known, "page_id").agg(F.avg((F.col("v") == F.col("verdict")).cast("double"))).first()[0]
    assert right > 0.95


def test_url_sample_holds_a_repeated_url_once(spark, monkeypatch):
    sizes, assembled = [], urlfilter.VectorAssembler.transform
    monkeypatch.setattr(urlfilter.VectorAssembler, "transform", lambda self, df: sizes.append(df.count()) or assembled(self, df))
    rows = [("http://a.net/x", 1)] * 3000 + [(f"http://b{i}.org/{i}", i % 2) for i in range(60)]
    labels = spark.createDataFrame(rows, "url string, label int")
    pages = labels.select(F.monotonically_increasing_id().alias("page_id"), "url")
    assert urlfilter.judge(pages, "page_id", "url", labels=labels).count() == 3060
    assert 0 < sizes[0] <= 61


def test_url_rates_leave_out_the_own_label(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "suffix string, label long").withColumn("section", F.col("suffix"))
    out = urlfilter.with_rates(rows, urlfilter.rates(rows, "suffix"), urlfilter.rates(rows, "section"), 0.5, own=True)
    assert {round(r["suffix_rate"], 6) for r in out.filter("suffix = 'b'").collect()} == {0.5}


def mix_rows(spark, rows):
    return spark.createDataFrame([(i, "w " * n if n is not None else None, s, "z", 1, 2) for i, n, s in rows], "doc_id long, text string, source string, h string, size int, taken int")


def test_mix_meets_targets_and_caps(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 40)), f"s{i % 7}" if i % 3 else "hot") for i in range(6000)]
    rows += [(10_000, None, None), (None, 4, None), (10_001, 9, None), (10_001, 9, None), (10_002, None, "empty")]
    docs = mix_rows(spark, rows)
    sizes = mixing.sized(docs)
    got = mixing.take(sizes, mixing.plan(sizes)).collect()
    assert len(got) == len(rows)
    total = sum(n or 0 for _, n, _ in rows)
    sources = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["times"] * r["size"]
        s = sources.setdefault(r["source"], [r["target"], r["source_size"], 0])
        s[2] += r["taken"]
    assert abs(sum(t for t, _, _ in sources.values()) - total) < 1e-6 * total
    for target, size, taken in sources.values():
        assert target <= 3 * size + 1e-9 and (abs(taken - target) <= 40 or size < 60)
    again = mixing.take(sizes.repartition(5), mixing.plan(sizes.repartition(5))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["times"] for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mix_reshares_the_excess(spark):
    rows = [(i, 10, "a") for i in range(2)] + [(10 + i, 10, "b") for i in range(50)] + [(100 + i, 10, "c") for i in range(50)]
    sizes = mixing.sized(mix_rows(spark, rows))
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 60 and abs(got["b"] - 960 * 2 / 3) < 1e-9 and abs(got["c"] - 320) < 1e-9
    rows = spark.createDataFrame([(7, "a"), (None, "a"), (7, None)], "i long, t string").select(mixing.row_hash(F.col("i"), F.col("t"))).collect()
    digest = hashlib.md5(b"a").hexdigest()
    assert [f"{r[0]:09x}" for r in rows] == [hashlib.md5(x.encode()).hexdigest()[:9] for x in (f"7 {digest}", digest, "7")]


def test_mix_splits_sources_without_ids(spark):
    rows = [(None if s == "a" else 7, f"{s} {i} " + "w " * 8, s) for s in "abc" for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.sized(docs)
    got = mixing.take(sizes, mixing.plan(sizes)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in got) and len(got) == 3
    assert sum(r["taken"] for r in got) == 10 * mixing.mixed(docs).count()
