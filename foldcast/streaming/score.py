"""Scoring an append-only panel as it grows: each micro-batch adds days, and the latest origins are forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import forecast_sql
from ..operators.panel import with_t


def score_latest(stream: DataFrame, history: str, output: str, checkpoint: str, lookback: int) -> StreamingQuery:
    """Append each batch of (date, series, value) to ``history`` and write AR(1) forecasts of the batch's dates to ``output``.

    A batch only reads the last lookback + 2 dates before its own: a calendar of the dates of each batch stands beside
    the history, which itself is laid out by date. All writes are keyed by the batch id, so a batch that is run again
    after a failure replaces what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.repartition("date").write.mode("overwrite").partitionBy("date").parquet(f"{history}/batch={number}")
        days = f"{history}/_dates"  # hidden from readers of the history
        batch.select("date").distinct().coalesce(1).write.mode("overwrite").parquet(f"{days}/batch={number}")
        calendar = spark.read.schema("date date").option("recursiveFileLookup", "true").parquet(days)
        first = spark.read.schema("date date").parquet(f"{days}/batch={number}").agg(F.min("date").alias("d")).first().d
        if first is None:
            return
        before = calendar.filter(F.col("date") < F.lit(first)).distinct().orderBy(F.desc("date")).limit(lookback + 2).agg(F.min("date").alias("d")).first().d
        every = spark.read.schema(batch.schema).parquet(history).drop("batch")
        recent = with_t(every.filter(F.col("date") >= F.lit(before or first)))
        dates = recent.select("t", "date").distinct()
        scored = forecast_sql.ar1(recent, lookback).join(dates, "t").filter(F.col("date") >= F.lit(first)).select("date", "series", "f")
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
