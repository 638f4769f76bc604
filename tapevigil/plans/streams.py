"""Streams run to their end inside a query: a table is fed as files, the result is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapevigil.plans.storage import settle, shared_folder


def feed(df: DataFrame) -> DataFrame:
    """A stream over the rows of df, which is written to the shared folder first."""
    written = settle(df)
    folder = written.inputFiles()[0].rsplit("/", 1)[0] if written.inputFiles() else None
    if folder is None:
        raise ValueError("a stream needs at least one file")
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def feed_in_turn(df: DataFrame, turn: Column) -> DataFrame:
    """A stream over df in several micro-batches: the rows of each value of `turn`, in its order.

    Each turn is one file, as a trigger takes whole files; a turn should be what a trigger would.
    """
    spark = df.sparkSession
    rows = settle(df.withColumn("__turn", turn))
    place = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    for (value,) in rows.select("__turn").distinct().orderBy("__turn").collect():
        rows.where(F.col("__turn").eqNullSafe(value)).drop("__turn").coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(place)


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that an append stream puts out over the data that is there, as a table."""
    place = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/rows")
        .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
