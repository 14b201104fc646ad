"""Rolling-origin windows: row ranges of validation folds and final fits, and the run grid.

N rows t = 0..N-1, lookback L, v validation folds, target offset o (1: forecast the day after the origin; 0: the origin
itself). Origins d run from L to N-2. Fold s has rows [d-L+s, d-v+o+s], the final slice is [d-L, d+o]; the last row of a
slice is its target and lags are taken inside the slice, so a lag-p fit trains on the rows from the p-th to the target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    lookback: int = 1008
    days_valid: int = 20
    target_offset: int = 1

    def __post_init__(self):
        if self.lookback <= self.days_valid:
            raise ValueError(f"lookback_days ({self.lookback}) must be greater than days_valid ({self.days_valid})")
        if self.target_offset not in (0, 1):
            raise ValueError("target_offset is 0 or 1")

    def origins(self, rows: int) -> range:
        """Origins of a panel of ``rows`` rows; none if rows = L + 1; fewer rows are an error."""
        if rows < self.lookback + 1:
            raise ValueError(f"{rows} rows are too few for a lookback of {self.lookback}: at least {self.lookback + 1} are needed")
        return range(self.lookback, rows - 1)

    def fold(self, d: int, s: int) -> tuple[int, int]:
        return max(0, d - self.lookback) + s, d - self.days_valid + self.target_offset + s

    def final(self, d: int) -> tuple[int, int]:
        return max(0, d - self.lookback), d + self.target_offset


def origins(spark: SparkSession, rows: int, spec: WindowSpec) -> DataFrame:
    days = spec.origins(rows)
    return spark.range(days.start, days.stop).select(F.col("id").cast("int").alias("origin"))


def run_grid(spark: SparkSession, rows: int, spec: WindowSpec, p_max: int, alphas: list[float] | None = None) -> DataFrame:
    """(origin, p, alpha, shift), one row for each fit of a validation fold."""
    grid = origins(spark, rows, spec).withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(p_max))))
    grid = grid.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))) if alphas else F.lit(None).cast("double"))
    return grid.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(spec.days_valid - 1))))


def fold_windows(spark: SparkSession, rows: int, spec: WindowSpec) -> DataFrame:
    """(origin, shift, lo, hi): inclusive row range of each fold; hi is the target."""
    grid = origins(spark, rows, spec).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(spec.days_valid - 1))))
    start = F.greatest(F.lit(0), F.col("origin") - spec.lookback)
    return grid.select("origin", "shift", (start + F.col("shift")).alias("lo"), (F.col("origin") - spec.days_valid + spec.target_offset + F.col("shift")).alias("hi"))


def final_windows(spark: SparkSession, rows: int, spec: WindowSpec) -> DataFrame:
    """(origin, lo, hi): inclusive row range of each final fit."""
    start = F.greatest(F.lit(0), F.col("origin") - spec.lookback)
    return origins(spark, rows, spec).select("origin", start.alias("lo"), (F.col("origin") + spec.target_offset).alias("hi"))


def time_series_split(spark: SparkSession, rows: int, folds: int) -> DataFrame:
    """(fold, train_rows, test_lo, test_hi) of expanding-window cross-fitting over ``rows`` rows."""
    h = rows // (folds + 1)
    first = F.lit(rows) - (F.lit(folds) - F.col("id")) * h
    return spark.range(folds).select(F.col("id").cast("int").alias("fold"), first.cast("int").alias("train_rows"), first.cast("int").alias("test_lo"), (first + h - 1).cast("int").alias("test_hi"))
