"""Writing results: one Parquet table a result, the performance table as one CSV, the configuration as JSON."""

from __future__ import annotations

import atexit
import dataclasses
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share, or, unset on a local master, one of our own; it goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended before the process
            pass

    atexit.register(drop)
    return folder


def save_returns(panel: DataFrame, path: str) -> None:
    """A long panel as the wide CSV that sources.tables.read_returns reads: a row a series, a column a date."""
    cells = panel.select(F.col("series").alias("ticker"), F.concat(F.lit("X"), F.date_format("date", "yyyyMMdd")).alias("day"), "value")
    cells.groupBy("ticker").pivot("day").agg(F.first("value")).write.mode("overwrite").csv(path, header=True)


def save_confounder(panel: DataFrame, path: str) -> None:
    """One series of a long panel as a CSV with the columns observation_date and the series."""
    name = panel.select("series").first().series
    panel.select(F.col("date").alias("observation_date"), F.col("value").alias(name)).write.mode("overwrite").csv(path, header=True)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def save_performance(table: DataFrame, folder: str) -> None:
    """A row a strategy, so one file is right."""
    table.coalesce(1).write.mode("overwrite").csv(f"{folder}/performance", header=True)


def save_config(spark: SparkSession, config, folder: str) -> None:
    text = json.dumps(dataclasses.asdict(config), default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def summary(table: DataFrame) -> str:
    """A line a strategy, as printed at the end of a run."""
    rows = table.orderBy("strategy").collect()
    show = lambda x: "-" if x is None else f"{x:.4f}"
    return "\n".join(f"{r.strategy}: {show(r.annualized_return_pct)} % a year, Sharpe {show(r.sharpe_ratio)}, total {show(r.total_return)}" for r in rows)


def lag_plot(selection: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, p_opt) of the chosen lag over time, for a step plot; dates are (t, date)."""
    return selection.select(F.col("target_t").alias("t"), "p_opt").join(dates, "t").select("date", "p_opt")


def strategy_plot(pnl: DataFrame, dates: DataFrame, adjusted: bool) -> DataFrame:
    """(date, strategy, percent): cumulative returns, a line a strategy; buy-and-hold only if returns are unadjusted."""
    shown = pnl.filter(F.col("strategy") != "buy_and_hold") if adjusted else pnl
    return shown.join(dates, "t").select("date", "strategy", (F.col("cumulative") * 100).alias("percent"))
