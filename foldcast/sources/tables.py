"""Reading panels: wide CSV of returns, CSVs of confounders, and panels derived from order and line tables."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.panel import nan_to_null, outer_merge, with_t

log = logging.getLogger(__name__)
SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SCALE = 0.01


def header_date(name):
    """The date of a column header such as X20000103 (leading X, then yyyymmdd)."""
    return F.to_date(F.ltrim(name, F.lit("X")), "yyyyMMdd")


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a row a ticker and a column a trading date, as a long panel (date, series, value, place).

    place rises in the order of the tickers in the file.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    days = [c for c in raw.columns if c != "ticker"]
    long = raw.withColumn("place", F.monotonically_increasing_id()).unpivot(["ticker", "place"], days, "header", "text")
    return nan_to_null(long.select(header_date("header").alias("date"), F.col("ticker").alias("series"), F.col("text").try_cast("double").alias("value"), "place"))


def read_confounders(spark: SparkSession, paths: list[str], on_missing: str = "skip", until: dict[str, str] | None = None) -> DataFrame | None:
    """CSVs whose first column is observation_date, outer-merged on the date; None if there is nothing to read.

    Series that occur in two files get the file's number as a suffix. A missing file is skipped with a warning, or
    raises with on_missing='raise'. ``until`` gives the last date to take of a path.
    """
    frames, seen = [], set()
    for i, path in enumerate(paths):
        try:
            raw = spark.read.csv(path, header=True, inferSchema=False)
        except AnalysisException:
            if on_missing != "skip":
                raise
            log.warning("no confounder file %s", path)
            continue
        if raw.columns[:1] != ["observation_date"]:
            raise ValueError(f"{path}: the first column is {raw.columns[:1]}, not observation_date")
        names = {c: c if c not in seen else f"{c}_{i}" for c in raw.columns[1:]}
        seen |= set(names.values())
        columns = [F.col(f"`{c}`").try_cast("double").alias(n) for c, n in names.items()]
        dated = raw.select(F.to_date("observation_date").alias("date"), *columns)
        if until and path in until:
            dated = dated.filter(F.col("date") <= F.to_date(F.lit(until[path])))
        frames.append(nan_to_null(dated.unpivot("date", list(names.values()), "series", "value")))
    return outer_merge(frames) if frames else None


#: The confounder files of each group.
SOURCES = {
    "macro": ["DFF_20000103_20201231", "T5YIE_20030102_20201231", "USEPUINDXD_20000103_20201231", "DFII10_20030102_20201231"],
    "trade": ["DCOILWTICO_20000103_20201231", "DTWEXBGS_20060102_20201231", "DTWEXEMEGS_20060102_20201231", "GVZCLS_20080603_20201231"],
    "vix": ["VIX_20000103_20201231"],
    "covid": ["USCOVIDDATA_20200101_20221231"],
}


def source_files(folder: str, **use: bool) -> list[str]:
    """The confounder files of the groups that are switched on (macro, trade, vix, covid)."""
    if unknown := set(use) - set(SOURCES):
        raise ValueError(f"unknown confounder groups {sorted(unknown)}")
    return [f"{folder}/{name}.csv" for group, names in SOURCES.items() if use.get(group) for name in names]


def spend_levels(spark: SparkSession, sf_dir: str, bucket: str = "week", fill: bool = True) -> DataFrame:
    """(date, series, level): spend by order priority and week (or month); with fill, absent cells are 0, and a priority that is not in SERIES is an error."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.date_trunc(bucket, F.col("o_orderdate").cast("timestamp")).cast("date").alias("date"), F.col("o_orderpriority").alias("series"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    cells = orders.groupBy("date", "series").agg(F.sum("price").cast("double").alias("level"))
    if not fill:
        return cells
    every = cells.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("series", "level"))).alias("have"))
    other = F.array_except(F.map_keys("have"), F.array(*map(F.lit, SERIES)))
    every = every.withColumn("have", F.when(F.size(other) == 0, F.col("have")).otherwise(F.raise_error(F.concat(F.lit("unknown order priorities: "), F.concat_ws(", ", other))).cast("map<string,double>")))
    return every.select("date", F.explode(F.array(*map(F.lit, SERIES))).alias("series"), "have").select("date", "series", F.coalesce(F.try_element_at("have", F.col("series")), F.lit(0.0)).alias("level"))


def spend_panel(spark: SparkSession, sf_dir: str, bucket: str = "week", fill: bool = True) -> DataFrame:
    """(t, date, series, value): scaled log changes of spend; the first bucket is dropped.

    A filled panel has every date in every series, so the row number within a series is t: orders are read once and the
    dates need no table of their own.
    """
    w = Window.partitionBy("series").orderBy("date")
    levels = spend_levels(spark, sf_dir, bucket, fill)
    change = levels.withColumn("value", F.lit(SCALE) * (F.log(1 + F.col("level")) - F.log(1 + F.lag("level").over(w))))
    if fill:
        return change.withColumn("t", F.row_number().over(w) - 2).filter("t >= 0").select("t", "date", "series", "value")
    first = levels.agg(F.min("date").alias("first"))
    return with_t(change.crossJoin(F.broadcast(first)).filter("date > first").select("date", "series", "value"))


def ship_confounders(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """(date, series, value): averages of shipped lines; C_QTY has interior gaps, C_PRICE leading and trailing ones."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.date_trunc(bucket, F.col("l_shipdate").cast("timestamp")).cast("date").alias("date"), "l_discount", "l_quantity", "l_extendedprice")
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c)
    weeks = lines.groupBy("date").agg(mean("l_discount").alias("d"), mean("l_quantity").alias("q"), mean("l_extendedprice").alias("p"))
    weeks = weeks.withColumn("n", F.row_number().over(Window.orderBy("date")))
    inside = F.col("date").between(F.to_date(F.lit("1996-01-01")), F.date_sub(F.to_date(F.lit("2001-06-01")), 1))
    parts = F.array(
        F.struct(F.lit("C_DISC").alias("series"), F.col("d").alias("value")),
        F.struct(F.lit("C_QTY").alias("series"), F.when(F.col("n") % 3 == 0, F.col("q")).alias("value")),
        F.struct(F.lit("C_PRICE").alias("series"), F.when(inside, F.col("p")).alias("value")),
    )
    return weeks.select("date", F.inline(parts))
