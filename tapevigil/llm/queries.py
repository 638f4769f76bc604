"""Registered queries of the operators: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapevigil.llm import (
    bpe,
    codes,
    embdedup,
    hamming,
    jaccard,
    langid,
    linededup,
    mixing,
    packing,
    ranking,
    substring,
    tokencount,
    urlfilter,
)
from tapevigil.llm.common import prepare, stored

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Rank file and pre-token pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


#: Remainder of crc32(doc_id) by 4 that training never sees.
HELD_OUT = 2


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


@query("op1_language_id")
def language_id(spark, sf):
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", F.round("p.score", 9).alias("score"))


@query("op2_line_dedup", linededup.SQL)
def line_dedup(spark, sf):
    """Lines of recurring templates, removed from every document."""
    out = linededup.deduplicated(table(spark, sf, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def substring_dedup(spark, sf):
    """Words in repeated windows, removed from every document."""
    out = substring.deduplicated(table(spark, sf, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_ngram_jaccard")
def ngram_jaccard(spark, sf):
    """Class and number of links of every document, word 5-grams, similarity 0.8 or more."""
    return jaccard.joined(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query("op5_url_filter")
def url_filter(spark, sf):
    """Verdict on every page's URL; the trees learn from the URLs that the rules label."""
    judged = urlfilter.judge(table(spark, sf, "pages"), "page_id", "url")
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_byte_bpe")
def byte_bpe(spark, sf):
    """Ids of every document and the bytes they decode to, as digests."""
    ranks, pattern = tokenizer()
    docs = table(spark, sf, "documents")
    out = docs.select("doc_id", bpe.round_trip(spark, F.col("text"), ranks, pattern).alias("t"))
    return out.select(
        "doc_id", bpe.token_count(F.col("t.ids")).alias("n_tokens"), F.sha2("t.ids", 256).alias("ids_sha256"),
        F.sha2("t.raw", 256).alias("decoded_sha256"),
    )


@query("op7_hamming_search", hamming.SQL)
def hamming_search(spark, sf):
    """The 10 nearest sign codes of every vector whose id is divisible by 50, among all vectors."""
    codes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.search(codes, codes.filter("id % 50 = 0"))
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


@query("op8_token_counts")
def token_counts(spark, sf):
    """Unigram token counts of every document."""
    ranks, pattern = tokenizer()
    counted = table(spark, sf, "documents").select("doc_id", tokencount.counts(spark, F.col("text"), ranks, pattern).alias("c"))
    return counted.select("doc_id", "c.n_tokens", "c.n_pretokens")


@query("op9_embedding_dedup")
def embedding_dedup(spark, sf):
    """Links, component and kept flag of every vector, cosine 0.93 or more within a label."""
    return embdedup.linked(table(spark, sf, "embeddings"))


@query("op10_source_mix", mixing.SQL)
def source_mix(spark, sf):
    """Words that the mix takes of every document."""
    sizes = stored(mixing.sized(table(spark, sf, "documents")))
    taken = mixing.take(sizes, mixing.plan(sizes))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query("op11_lexical_search", ranking.SQL)
def lexical_search(spark, sf):
    """The 10 documents with the highest scores for every benchmark item."""
    found = ranking.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query("op12_vector_codes", codes.SQL)
def vector_codes(spark, sf):
    """Code and error of every vector that is kept."""
    found, books = codes.coded(table(spark, sf, "embeddings"))
    out = codes.with_label_error(found)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query("op13_packing")
def pack(spark, sf):
    """Pieces of all documents, packed into sequences of 2,048 tokens."""
    vocabulary, pattern = tokenizer("byte_bpe_50k.json")
    out = packing.packed(table(spark, sf, "documents"), vocabulary, pattern)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
