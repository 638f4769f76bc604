"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments. Codes within Hamming distance d of a query
differ from it by at most d / segments bits in some segment. Round r joins the
query's segments, with every r bits flipped, to an index by segment and value;
after it all codes within segments * r + segments - 1 are known. A query stops
when its k-th verified distance is that small. Later rounds join only the codes
that can still enter a query's list.

Equal codes are one index entry with their smallest ids, as many as a list can
use, so copies cost nothing. Segments have about log2(rows) bits, which keeps
index entries few; this choice changes no result.

Defined results: equal distances go by id; a row is not its own neighbour (equal
ids); rows without a code are left out; a table of fewer rows gives shorter
lists; repeated rows (equal id and code) count once. Only named columns are
read, so other columns' names don't matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapevigil.llm.common import stored

BITS = 64


def sign_code(vector: Column) -> Column:
    """Code of a vector of 64 finite components: a bit for each positive one, the first highest; else null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    bits = F.aggregate(vector, F.lit(0).cast("long"), lambda code, x: F.shiftleft(code, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    return F.when((F.size(vector) == BITS) & ~bad, bits)


def segment_bits(rows: int) -> int:
    return next((b for b in (8, 16) if rows < 1 << b * 3 // 2), 32)


def segments(code: Column, bits: int) -> Column:
    """array of (segment, value)."""
    low = F.lit((1 << bits) - 1)
    return F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(code, s * bits).bitwiseAND(low).alias("v")) for s in range(BITS // bits)])


def flips(bits: int, radius: int) -> Column:
    """All values of `bits` bits of which `radius` are set."""
    values = ",".join(str(sum(1 << i for i in chosen)) for chosen in combinations(range(bits), radius))
    return F.split(F.lit(values), ",").cast("array<long>")


def first_found(a: Column, b: Column, segment: Column, radius: int, bits: int) -> Column:
    """Whether the pair is met in this round first, and in this segment first."""
    low = F.lit((1 << bits) - 1)
    differ = [F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), s * bits).bitwiseAND(low)) for s in range(BITS // bits)]
    later = [d > radius for d in differ]
    sooner = [d >= radius for d in differ]
    met = F.lit(False)
    for s in range(BITS // bits):
        here = (segment == s)
        for t in range(BITS // bits):
            if t != s:
                here = here & (later[t] if t < s else sooner[t])
        met = met | here
    return met


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest (distance, id) of each q."""
    order = Window.partitionBy("q").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, id, distance): the k nearest rows(id, code) of each of queries(id, code)."""
    wanted = k + 1  # a query's own row is among them
    distinct = rows.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    ids = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("rank") <= wanted)
    entries = stored(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = entries.agg(F.count("*"), F.sum(F.size("ids"))).first()
    bits, reachable = segment_bits(n[0]), min(wanted, n[1] or 0)
    index = stored(entries.select("code", "ids", F.explode(segments(F.col("code"), bits)).alias("x")).select("code", "ids", "x.s", "x.v"))
    asked = queries.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    active = stored(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)))
    found, done = None, []
    for radius in range(bits + 1):
        probes = active.select("q", "bound", F.explode(segments(F.col("q"), bits)).alias("x")).select("q", "bound", "x.s", F.col("x.v").alias("base"))
        probes = probes.withColumn("flip", F.explode(flips(bits, radius))).select("q", "bound", F.col("s").alias("ps"), F.col("base").bitwiseXOR(F.col("flip")).alias("pv"))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        meets = (F.col("ps") == F.col("s")) & (F.col("pv") == F.col("v")) & (distance <= F.col("bound")) & first_found(F.col("q"), F.col("code"), F.col("s"), radius, bits)
        # Probes are many times the queries that they are made of, which plans don't know: never broadcast them.
        new = probes.hint("merge").join(index, meets).select("q", distance.alias("distance"), F.explode("ids").alias("id"))
        lists = stored(best(new if found is None else found.unionByName(new), wanted).select("q", "distance", "id"))
        covered = BITS // bits * (radius + 1) - 1
        ends = lists.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = active.drop("bound").join(ends, "q", "left").withColumn("whole", F.coalesce(F.col("n") >= reachable, F.lit(False)))
        state = stored(state.withColumn("ready", F.col("whole") & (F.col("last") <= covered)))
        done.append(lists.join(state.filter("ready").select("q"), "q", "left_semi"))
        active = stored(state.filter("NOT ready").select("q", F.when(F.col("whole"), F.col("last")).otherwise(BITS).cast("int").alias("bound")))
        found = stored(lists.join(active.select("q"), "q", "left_semi"))
        if not active.limit(1).count():
            break
    nearest = done[0]
    for more in done[1:]:
        nearest = nearest.unionByName(more)
    pairs = asked.select(F.col("id").alias("query"), F.col("code").alias("q")).join(nearest, "q").filter("id <> query")
    order = Window.partitionBy("query", "q").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "distance")


SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, CAST(list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b) AS BIT) AS code
  FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL),
ranked AS (
  SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code)) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, r.code)), r.vec_id) AS rank
  FROM codes q JOIN codes r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(distance AS INT) AS distance FROM ranked WHERE rank <= 10
"""
