"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Every document has a hash of its id and text. Sizes are summed by source and hash bucket;
in the running sum of a source's buckets one bucket crosses the source's budget,
and only that bucket is refined into smaller ones, twice. The result is a hash
threshold per source: documents below it are taken once more than the source's
whole repeats, so documents are chosen by a filter and never sorted. Only the
sums (at most `2**BITS` a source and level) are gathered.

Budgets: sources in code point order (null last) weigh `weights`, repeating. The
targets share the total size by weight, none above `cap` times its source's
size; the excess is shared again by weight. That is the level at which
min(cap * size, weight * level) adds up to the total.

Defined results: a null text has size 0; a null source is a source of its own; a
null id or text adds nothing to the hash; rows with equal id and text are taken alike; a source
without words has target 0 and its rows are taken 0 times; an empty table gives
an empty result. `plan` and `take` read named columns only; `mixed` returns all
columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.llm.common import stored, word_count

#: Hash bits that one level of the histogram resolves, and levels.
BITS, LEVELS = 12, 3


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 36 bits of the digest of id and text."""
    named = F.concat_ws(" ", doc_id.cast("string"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of documents."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, repeats, budget): one row per source; `budget` is what whole repeats leave."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    # Sources in the order in which a rising level reaches their caps; the first that the level does not fill sets it.
    limit = F.col("source_size") * cap
    filling = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("full", limit <= F.col("weight") * level)
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), limit).otherwise(F.col("weight") * final)
    ratio = F.floor(F.col("target") / F.col("source_size"))
    return (
        levels.withColumn("target", target)
        .withColumn("repeats", F.when(F.col("source_size") > 0, ratio).otherwise(0).cast("long"))
        .select("source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"))
    )


def plan(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source_targets and `cut`: rows with h below it are taken once more. Reads `sizes` once a level."""
    state = stored(source_targets(sizes, weights, cap).withColumn("below", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        s, p = sizes.alias("s"), state.select(F.col("source").alias("of"), "budget", "below", "prefix").alias("p")
        inside = (F.col("source").eqNullSafe(F.col("of"))) & (F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = (
            s.join(p, inside)
            .groupBy("of", "budget", "below", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("mass"))
        )
        run = F.col("below") + F.sum("mass").over(Window.partitionBy("of").orderBy("bucket"))
        crossing = sums.withColumn("run", run).filter(F.col("run") > F.col("budget"))
        edge = crossing.groupBy("of").agg(F.min(F.struct("bucket", "run", "mass")).alias("edge"))
        state = stored(
            state.join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
            .withColumn("prefix", F.coalesce(F.col("edge.bucket"), F.lit(-1).cast("long")))
            .withColumn("below", F.coalesce(F.col("edge.run") - F.col("edge.mass"), F.col("below")))
            .withColumn("run", F.col("edge.run"))
            .drop("of", "edge", *(["run"] if level < LEVELS else []))
        )
    nearer = F.col("run") - F.col("budget") < F.col("budget") - F.col("below")
    cut = F.when(F.col("prefix") >= 0, F.col("prefix") + F.when(nearer, 1).otherwise(0)).otherwise(F.lit(0).cast("long"))
    return state.select("source", "source_size", "target", "repeats", cut.alias("cut"))


def take(sizes: DataFrame, chosen: DataFrame) -> DataFrame:
    """sizes with source_size, target, times (how often a row is taken) and taken (times x size)."""
    c = chosen.withColumnRenamed("source", "of")
    times = F.when(F.col("source_size") > 0, F.col("repeats") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).otherwise(0)
    return (
        sizes.join(c, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("times", times.cast("long"))
        .withColumn("taken", F.col("times") * F.col("size"))
        .drop("of", "repeats", "cut", "h")
    )


def mixed(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """All columns of docs, each row as often as the mix takes it."""
    chosen = plan(stored(sized(docs)), weights, cap).withColumnRenamed("source", "of")
    row = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    times = F.when(F.col("source_size") > 0, F.col("repeats") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).otherwise(0)
    return (
        row.join(chosen, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select("row.*")
    )


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(' ', CAST(doc_id AS VARCHAR), md5(text))), 1, 9) AS BIGINT) AS h
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM by_source),
levels AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighed
  WINDOW w AS (ORDER BY source_size * 3.0::DOUBLE / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT max(level) FILTER (lim > weight * level) AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN lim <= weight * levels.level THEN lim ELSE weight * final.level END AS target
  FROM levels, final),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets),
buckets AS (SELECT source, h, sum(size) AS mass FROM sizes GROUP BY source, h),
runs AS (SELECT *, sum(mass) OVER (PARTITION BY source ORDER BY h) AS run FROM buckets),
edges AS (
  SELECT runs.source, target - repeats * source_size AS budget, min(h) AS h, arg_min(run, h) AS run, arg_min(mass, h) AS mass
  FROM runs JOIN plan ON runs.source IS NOT DISTINCT FROM plan.source
  WHERE run > target - repeats * source_size GROUP BY ALL),
cuts AS (SELECT source, h + CASE WHEN run - budget < budget - (run - mass) THEN 1 ELSE 0 END AS cut FROM edges)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN repeats + CASE WHEN h < coalesce(cut, 0) THEN 1 ELSE 0 END ELSE 0 END * size AS BIGINT) AS taken
FROM sizes JOIN plan ON sizes.source IS NOT DISTINCT FROM plan.source
LEFT JOIN cuts ON sizes.source IS NOT DISTINCT FROM cuts.source
"""
