"""URL filter: host/path rules first, gradient-boosted trees on lexical features for the rest.

A rule (host, path) fits its host and all subdomains if the URL's path starts
with the rule's path; the longest rule wins. URLs that no rule fits get the
verdict of gradient-boosted trees. Their features are the lengths of URL, host
and path, path depth, labels in the host, digit ratio, character entropy,
parameter count, hyphens, and suffix statistics: the smoothed share of blocked
URLs among labelled ones with the same host suffix (last label) and with the
same suffix and first path part. Labelled URLs are given by the caller. Blocked
and allowed ones weigh alike in trees and statistics, however many there are of
each. One labelled URL in four is learned without its suffix statistics, so that
the trees judge a URL of unknown suffix by its other features.

Training draws at most about `sample_rows` different labelled URLs by a hash, the one
bounded sample; suffix statistics are sums over all labelled URLs.

Defined results: a null URL or one without "://" has empty host and path, no rule,
and the trees' verdict on its features; with no labelled URL of either kind the
verdict is the only kind there is, or "allow". Repeated URLs get equal verdicts.
Only named columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapevigil.llm.common import stored

Rule = tuple[str, str, str]

#: (verdict, host, path) of the production rules.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens",
    "suffix_rate", "section_rate",
)
#: Weight of one half in a suffix's smoothed share.
SMOOTHING = 20.0
MASKED = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column; both empty where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def features(urls: DataFrame) -> DataFrame:
    """urls(key, url, host, path, ...) with the features that need no labels."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    # A character's share is what the text loses without it; the entropy sums -p log p over distinct characters.
    shares = F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": entropy,
        "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "suffix": F.element_at(F.split(host, r"\."), -1),
        "section": F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), F.regexp_extract(path, "^/([^/]*)", 1)),
    })


def weights(share: float) -> tuple[float, float]:
    """Weight of a blocked and of an allowed URL that give both kinds half of the whole; `share` are blocked."""
    return (0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else (1.0, 1.0)


def rates(labelled: DataFrame, key: str) -> DataFrame:
    """Blocked and labelled URLs by `key`."""
    return labelled.groupBy(F.col(key).alias(f"{key}_key")).agg(F.sum("label").alias(f"{key}_bad"), F.count("*").alias(f"{key}_all"))


def with_rates(rows: DataFrame, suffixes: DataFrame, sections: DataFrame, share: float, own: bool) -> DataFrame:
    """suffix_rate and section_rate, both kinds weighing alike; a labelled row's own label is left out of its rates (`own`)."""
    block_weight, allow_weight = weights(share)
    out = rows.join(suffixes, F.col("suffix") == F.col("suffix_key"), "left").join(sections, F.col("section") == F.col("section_key"), "left")
    for key in ("suffix", "section"):
        bad, n = F.coalesce(f"{key}_bad", F.lit(0)), F.coalesce(f"{key}_all", F.lit(0))
        if own:
            bad, n = bad - F.col("label"), n - 1
        weighed = bad * block_weight
        out = out.withColumn(f"{key}_rate", (weighed + 0.5 * SMOOTHING) / (weighed + (n - bad) * allow_weight + SMOOTHING))
    return out.drop("suffix_key", "suffix_bad", "suffix_all", "section_key", "section_bad", "section_all")


def fit(labelled: DataFrame, suffixes: DataFrame, sections: DataFrame, share: float, sample_rows: int, total: int) -> GBTClassificationModel:
    """Trees from about `sample_rows` rows of labelled(url, label, features)."""
    rate = min(1.0, sample_rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(1 << 40)) / float(1 << 40)
    # A URL is drawn whole or not at all; repeated ones count once, so that the sample stays bounded.
    drawn = labelled.filter(draw < rate).dropDuplicates(["url", "label"])
    sample = with_rates(drawn, suffixes, sections, share, own=True)
    # One URL in MASKED learns without statistics, as one with an unknown suffix will be judged.
    masked = F.pmod(F.xxhash64(F.lit(7), "url"), F.lit(MASKED)) == 0
    sample = sample.withColumns({c: F.when(masked, 0.5).otherwise(F.col(c)) for c in ("suffix_rate", "section_rate")})
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    # A bounded sample in a fixed order: sums of doubles agree between reruns.
    block_weight, allow_weight = weights(share)
    weight = F.when(F.col("label") == 1, block_weight).otherwise(allow_weight)
    columns = vectors.select("url", "features", F.col("label").cast("double").alias("label"), weight.alias("weight"))
    ordered = columns.repartition(1).sortWithinPartitions("url", "label")
    return GBTClassifier(maxIter=15, maxDepth=4, seed=5, maxBins=32, weightCol="weight").fit(ordered)


def judge(urls: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None,
          sample_rows: int = 8000) -> DataFrame:
    """(id, host, path, rule, verdict, block_probability) of every URL.

    labels(url, label) are labelled URLs, label 1 for block; without them the URLs that the rules judge are the
    labelled ones.
    """
    url = F.col(url_col)
    host, path = split_url(url)
    base = urls.select(F.col(id_col).alias("key"), url.alias("url"), host.alias("host"), path.alias("path"))
    base = features(base.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)))
    if labels is None:
        labelled = base.filter("fit IS NOT NULL").withColumn("label", (F.col("fit.verdict") == "block").cast("long"))
    else:
        h, p = split_url(F.col("url"))
        labelled = features(labels.select("url", F.col("label").cast("long").alias("label")).withColumns({"host": h, "path": p}))
    suffixes, sections = stored(rates(labelled, "suffix")), stored(rates(labelled, "section"))
    total, bad = suffixes.agg(F.sum("suffix_all"), F.sum("suffix_bad")).first()
    share = (bad or 0) / max(total or 0, 1)
    scored = with_rates(base, suffixes, sections, share, own=False)
    if 0 < share < 1:
        model = fit(labelled, suffixes, sections, share, sample_rows, total)
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scored)
        scored = model.transform(ready).withColumn("p", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("p", F.lit(share))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("p") > 0.5, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("p").alias("block_probability"))
