"""Text expressions: clean-up, cashtags, tokens, lexicon sentiment, fingerprints."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.functions.scalars import bind

# Word weights of the default sentiment lexicon.
POSITIVE = {
    "moon": 1.0, "mooning": 1.0, "bullish": 0.9, "pump": 0.7, "pumping": 0.8, "rally": 0.8,
    "surge": 0.8, "soar": 0.9, "breakout": 0.8, "gains": 0.7, "profit": 0.7, "buy": 0.5,
    "long": 0.4, "accumulate": 0.6, "hodl": 0.5, "ath": 0.8, "green": 0.5, "up": 0.3,
    "rocket": 0.9, "gem": 0.8, "undervalued": 0.7, "strong": 0.6, "support": 0.4,
    "adoption": 0.7, "partnership": 0.7, "listing": 0.8, "burn": 0.6, "staking": 0.4,
    "bounce": 0.6, "recovery": 0.6, "outperform": 0.8, "upgrade": 0.6, "beat": 0.6,
    "100x": 1.0, "10x": 0.9, "parabolic": 0.9, "squeeze": 0.6, "golden": 0.6, "win": 0.6,
    "🚀": 1.0, "🌙": 0.8, "📈": 0.8, "💎": 0.7, "🔥": 0.6, "🐂": 0.8, "✅": 0.4, "💰": 0.6,
}
NEGATIVE = {
    "dump": -0.8, "dumping": -0.9, "bearish": -0.9, "crash": -1.0, "collapse": -1.0,
    "rug": -1.0, "rugpull": -1.0, "scam": -1.0, "sell": -0.5, "short": -0.4, "fud": -0.5,
    "fear": -0.6, "panic": -0.9, "liquidated": -0.9, "liquidation": -0.8, "loss": -0.7,
    "down": -0.3, "red": -0.5, "weak": -0.6, "resistance": -0.3, "overvalued": -0.7,
    "bubble": -0.7, "exploit": -1.0, "hacked": -1.0, "hack": -0.9, "exit": -0.7,
    "delisting": -0.9, "delisted": -0.9, "halt": -0.7, "investigation": -0.7, "lawsuit": -0.7,
    "ponzi": -1.0, "honeypot": -1.0, "capitulation": -0.9, "bleeding": -0.8, "rekt": -0.9,
    "📉": -0.8, "🐻": -0.8, "💀": -0.8, "🩸": -0.8, "⚠️": -0.5, "🚨": -0.5,
}
INTENSIFIERS = {
    "very": 1.5, "extremely": 1.8, "super": 1.5, "massive": 1.7, "huge": 1.6,
    "insane": 1.7, "absolutely": 1.6, "totally": 1.4, "slightly": 0.5, "kinda": 0.6,
}
NEGATIONS = (
    "not", "no", "never", "isn't", "aren't", "wasn't", "won't", "don't", "doesn't",
    "didn't", "can't", "cannot", "nothing", "nobody", "without",
)
NEGATION_FACTOR = -0.85

# Patterns. Word characters are letters, digits and underscore of any script.
URL = r"(?U)https?://\S+|www\.\S+"
MENTION = r"@[\p{L}\p{N}_]+"
SPACES = r"(?U)\s+"
CASHTAG = r"[$#]([A-Za-z]{2,10})(?![\p{L}\p{N}_])"
TOKEN = r"[\p{L}\p{N}_'#$]+|[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
WORD = r"[a-z0-9$#]+"


def normalize_text(text: Column) -> Column:
    """Remove URLs and @mentions, squeeze whitespace."""
    bare = F.regexp_replace(F.regexp_replace(text, URL, " "), MENTION, " ")
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def extract_tickers(text: Column) -> Column:
    tags = F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1))
    return F.array_distinct(F.transform(tags, F.upper))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _weights(table: dict[str, float]) -> Column:
    flat = [F.lit(v) for pair in table.items() for v in pair]
    return F.create_map(*flat)


def lexicon_sentiment(text: Column) -> Column:
    """Struct(score, label, confidence) from the weighted lexicon.

    Each hit is scaled by the intensifiers and negations among the two tokens
    before it. Texts without any lexicon word skip the per-token work.
    """
    lexicon, boosts = _weights(POSITIVE | NEGATIVE), _weights(INTENSIFIERS)
    negations = F.array(*[F.lit(w) for w in NEGATIONS])
    words = F.array(*[F.lit(w) for w in POSITIVE | NEGATIVE])

    def factor(prev: Column) -> Column:
        boost = F.coalesce(F.try_element_at(boosts, prev), F.lit(1.0))
        return F.when(F.array_contains(negations, prev), boost * NEGATION_FACTOR).otherwise(boost)

    def contributions(tokens: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            before = F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
            scale = F.aggregate(before, F.lit(1.0), lambda acc, prev: acc * factor(prev))
            return F.when(F.array_contains(words, token), F.try_element_at(lexicon, token) * scale)

        return F.filter(F.transform(tokens, one), lambda c: c.isNotNull())

    def verdict(raw: Column, n: Column) -> Column:
        label = F.when(raw > 0.15, "positive").when(raw < -0.15, "negative").otherwise("neutral")
        return F.struct(
            F.round(raw, 4).alias("score"),
            label.alias("label"),
            F.round(F.least(F.lit(1.0), 0.35 + 0.12 * n), 3).alias("confidence"),
        )

    silent = F.struct(
        F.lit(0.0).alias("score"), F.lit("neutral").alias("label"), F.lit(0.25).alias("confidence")
    )

    def scored(hits: Column) -> Column:
        total = F.aggregate(hits, F.lit(0.0), lambda acc, c: acc + c)
        return bind(F.tanh(total / F.sqrt(F.size(hits)) / 1.6), lambda raw: verdict(raw, F.size(hits)))

    return bind(
        tokenize(normalize_text(text)),
        lambda tokens: F.when(F.arrays_overlap(tokens, words), bind(contributions(tokens), scored)).otherwise(silent),
    )


def model_sentiment(df: DataFrame, text: str, scorer: Callable[[list[str]], list[dict[str, float]]],
                    out: str = "sentiment") -> DataFrame:
    """Score texts with any model: `scorer` maps texts to {label: probability} dicts.

    score = positive - negative, confidence = 1 - neutral. A batch the scorer
    fails on falls back to the lexicon; `backend` says for each row which of the
    two it was ("model" or "lexicon"), and `error` what the scorer failed with.
    """

    @F.pandas_udf("score double, label string, confidence double, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        try:
            probs = scorer([t or "neutral" for t in texts])
        except Exception as fault:
            said = f"{type(fault).__name__}: {fault}"
            return pd.DataFrame({"score": [None] * len(texts), "label": None, "confidence": None, "error": said})
        return pd.DataFrame({
            "score": [round(p.get("positive", 0.0) - p.get("negative", 0.0), 4) for p in probs],
            "label": [max(p, key=p.get) for p in probs],
            "confidence": [round(1.0 - p.get("neutral", 0.0), 3) for p in probs],
            "error": None,
        })

    scored = df.withColumn("__m", run(normalize_text(F.col(text))))
    fallback = F.when(F.col("__m.score").isNull(), lexicon_sentiment(F.col(text)))
    parts = [F.coalesce(F.col(f"__m.{f}"), F.col(f"__l.{f}")).alias(f) for f in ("score", "label", "confidence")]
    backend = F.when(F.col("__m.score").isNotNull(), "model").otherwise("lexicon").alias("backend")
    return scored.withColumn("__l", fallback).withColumn(
        out, F.struct(*parts, backend, F.col("__m.error").alias("error"))).drop("__m", "__l")


def fingerprint(text: Column) -> Column:
    """Distinct three-word shingles; the distinct words when there are fewer than three."""
    def shingles(words: Column) -> Column:
        # Words are picked by index: a slice would copy all words of the text for each shingle.
        triples = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
            lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)),
        )
        return F.array_distinct(F.when(F.size(words) < 3, words).otherwise(triples))

    return bind(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), shingles)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
