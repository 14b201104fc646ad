"""Coefficient matching and multiple-testing adjustment as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_coefficients(before: DataFrame, after: DataFrame, outcomes: int) -> DataFrame:
    """(outcome, name, before_index, after_index) of outcome-major coefficient vectors; before_index is null for new ones.

    before and after are (j, name): the place of each treatment.
    """
    n, m = (F.lit(f.agg(F.count(F.lit(1)).alias("n")).first().n) for f in (before, after))
    both = after.select(F.col("j").alias("a"), "name").join(before.select(F.col("j").alias("b"), "name"), "name", "left")
    each = both.withColumn("outcome", F.explode(F.sequence(F.lit(0), F.lit(outcomes - 1))))
    return each.select("outcome", "name", (F.col("outcome") * n + F.col("b")).alias("before_index"), (F.col("outcome") * m + F.col("a")).alias("after_index"))


def least_adjusted(p_values: DataFrame, by: str, p: str = "p", tie: str | None = None) -> DataFrame:
    """(by, p_min): the smallest Benjamini-Hochberg adjusted p-value of each group, at most 1."""
    group = Window.partitionBy(by)
    ranked = p_values.withColumn("rank", F.row_number().over(group.orderBy(p, *([tie] if tie else [])))).withColumn("m", F.count(F.lit(1)).over(group))
    return ranked.groupBy(by).agg(F.least(F.min(F.col(p) * F.col("m") / F.col("rank")), F.lit(1.0)).alias("p_min"))
