"""Corpus pipeline over documents: what a training corpus goes through, as five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on
every row of docs and returns what it keeps, with all columns of docs but for
the last stage. Nulls, empty and long texts, repeated rows and further columns
are handled as the operators' modules state; an empty table stays empty.

1. language: documents with no letters, or unlike every language, go.
2. lines: lines of recurring templates go from the texts; n_chars follows.
3. near duplicates: one document of each group linked by similarity stays.
4. mix: rows are left out or repeated until sources have their target weights.
5. tokens: ids of each row's text, and the digest of the bytes they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapevigil.llm import bpe, jaccard, langid, linededup, mixing
from tapevigil.llm.common import prepare, stored
from tapevigil.llm.queries import tokenizer

#: Cosine with the nearest language below which a text of FULL_LETTERS letters or more is like none of them.
#: Unrelated texts have 0.04 on average and 0.12 in one of a hundred, as vectors have 1,024 dimensions. The
#: fewer letters, the less a text of a language resembles it, so the bound falls with their number.
LEAST_SCORE, FULL_LETTERS = 0.15, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    prepare(spark)
    told = langid.predict(F.col("text"), langid.fit(docs.filter("doc_id IS NOT NULL")))
    names = docs.columns
    judged = docs.select(F.struct("*").alias("row"), told.alias("told"))
    score, letters = F.col("told.score"), F.regexp_count(F.col("row").getField("text"), F.lit(r"\p{L}"))
    like = F.when(score >= LEAST_SCORE, True).otherwise(score >= LEAST_SCORE * F.least(letters / FULL_LETTERS, F.lit(1.0)))
    kept = judged.filter((F.col("told.lang_pred") != langid.UNKNOWN) & like)
    return kept.select(*[F.col("row").getField(n).alias(n) for n in names])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their lines of recurring templates."""
    out = linededup.deduplicated(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[changed.get(n, F.col("row").getField(n)).alias(n) for n in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    prepare(spark)
    return jaccard.distinct_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of every row; ids are packed 32-bit integers."""
    prepare(spark)
    ranks, pattern = tokenizer()
    out = docs.select("doc_id", "lang", "source", bpe.round_trip(spark, F.col("text"), ranks, pattern).alias("t"))
    return out.select(
        "doc_id", "lang", "source", bpe.token_count(F.col("t.ids")).alias("n_tokens"), "t.ids", F.sha2("t.raw", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("source_mix", mix), ("byte_bpe", tokens)]

#: Language ID and similarity can't be told in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
