"""Streaming scoring: state to vectors to signals, one pass per micro-batch.

Every batch writes its signals into a folder of its own and then one row into a
ledger. A batch that failed in between is run again by the engine and overwrites
its folder; readers take only batches of the ledger, so that each batch is seen
once and whole, whatever was interrupted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapevigil.operators.features import CONCURRENT_MS, HALF_LIFE_S, TTL_MS, informative, vectors_from_state
from tapevigil.operators.forest import ForestModel
from tapevigil.operators.scoring import score_vectors, signals
from tapevigil.streaming.state import latest_observations

LEDGER_DDL = "signals bigint, highest double, batch bigint"


def score_batch(state_rows: DataFrame, model: ForestModel | None, floor: float = 40.0, ttl_ms: int = TTL_MS,
                half_life_s: float = HALF_LIFE_S, concurrent_ms: int = CONCURRENT_MS) -> DataFrame:
    """Signals of one micro-batch of latest_observations rows: scores of `floor` and above, or urgent assets.

    An asset's rows of one moment make one vector. Urgency belongs to that moment: a later
    sweep of the same asset in the same batch must reach the floor by itself.
    """
    at = [F.col("asset").alias("asset_pair"), F.col("at_ms").alias("ts_ms")]
    urgent = state_rows.where("urgent").select(*at).distinct().withColumn("urgent", F.lit(True))
    vectors = vectors_from_state(state_rows, ttl_ms, half_life_s, concurrent_ms)
    scored = signals(score_vectors(informative(vectors), model))
    return scored.join(urgent, ["asset_pair", "ts_ms"], "left").where(
        (F.col("score") >= floor) | F.coalesce("urgent", F.lit(False))
    ).drop("urgent")


def ledger(spark: SparkSession, out_path: str) -> DataFrame:
    """One row per batch whose signals are complete."""
    place = f"{out_path}/_ledger"
    spark.createDataFrame([], "signals bigint, highest double").write.mode("ignore").parquet(f"{place}/batch=-1")
    return spark.read.schema(LEDGER_DDL).option("basePath", place).parquet(place)


def record(written: DataFrame, out_path: str, batch_id: int) -> None:
    """Enter a batch into the ledger, after its signals are written."""
    row = written.agg(F.count(F.lit(1)).alias("signals"), F.max("score").alias("highest"))
    row.write.mode("overwrite").parquet(f"{out_path}/_ledger/batch={batch_id}")


def published(spark: SparkSession, out_path: str) -> DataFrame:
    """The signals of all batches in the ledger; nothing is read of a batch that was interrupted."""
    done = ledger(spark, out_path).select("batch")
    rows = spark.read.parquet(out_path)
    return rows.withColumn("batch", F.col("batch").cast("bigint")).join(done, "batch", "left_semi")


def score_stream(events: DataFrame, out_path: str, checkpoint: str, model: ForestModel | None = None,
                 floor: float = 40.0, trigger: dict | None = None, ttl_ms: int = TTL_MS,
                 half_life_s: float = HALF_LIFE_S, concurrent_ms: int = CONCURRENT_MS, **state) -> StreamingQuery:
    """Run scoring on every micro-batch; `state` goes to latest_observations.

    The batch's state rows are kept in one folder that the next batch overwrites, as scoring
    reads them several times and the stateful stage must run once. out_path belongs to one
    checkpoint: batch numbers of another one would be taken for batches already done.
    """
    spark = events.sparkSession
    done = ledger(spark, out_path).agg(F.max("batch")).first()[0]
    last = -1 if done is None else done

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # A batch already in the ledger still runs its stateful stage, whose state the engine has not committed.
        batch.write.mode("overwrite").parquet(f"{out_path}/_rows")
        if batch_id <= last:
            return
        rows = session.read.schema(batch.schema).parquet(f"{out_path}/_rows")
        place = f"{out_path}/batch={batch_id}"
        score_batch(rows, model, floor, ttl_ms, half_life_s, concurrent_ms).write.mode("overwrite").parquet(place)
        record(session.read.parquet(place), out_path, batch_id)

    writer = latest_observations(events, ttl_ms=ttl_ms, **state).writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
