"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, read

#: A higher rate is drawn as a sum of equal parts of at most this rate, as exp(-rate) must not vanish.
PART = 512.0
TEMPERATURE, SEED = 0.5, "mix-1"


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the MD5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, source_col: str = "source", text_col: str = "text", most_epochs: float | None = None) -> DataFrame:
    """(source, rate, parts, cdf): the mean number of copies of each document of a source, and the cumulative Poisson terms of each of its equal parts.

    A source's target share is its weight over the sum of weights (an unlisted source has weight 0), or, without
    weights, its characters to the power ``temperature``. rate = share * epochs * all characters / the source's
    characters; with ``most_epochs`` at most that, and a source held to it misses its share. A source without characters keeps its documents at the rate ``epochs``.
    """
    size = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        goal = F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(0.0)
    else:
        goal = F.lit(0.0)
        for name, weight in sorted(weights.items()):
            goal = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(goal)
    sized = size.withColumn("goal", goal)
    total = sized.agg(F.sum("size").alias("all_size"), F.sum("goal").alias("all_goal"))
    wanted = F.col("goal") / F.col("all_goal") * F.lit(float(epochs)) * F.col("all_size") / F.col("size")
    rate = F.when(F.col("size") > 0, wanted if most_epochs is None else F.least(F.lit(float(most_epochs)), wanted)).otherwise(F.lit(float(epochs)))
    rated = sized.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(0.0)).alias("whole"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("whole") / PART)).cast("int")).withColumn("each", F.col("whole") / F.col("parts"))
    first = F.exp(-F.col("each"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.col("each") + 12 * F.sqrt("each") + 30).cast("int")),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct((s["p"] * F.col("each") / k.cast("double")).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("each") / k.cast("double"))).alias("c")),
    )
    return rated.select("source", F.col("whole").alias("rate"), "parts", terms["c"].alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most_epochs: float | None = None) -> DataFrame:
    """Every row as often as an inverted, hash-seeded Poisson distribution says, in a global shuffle.

    All columns of ``docs`` plus copy (from 1) and mix_key; within a partition rows are in the order of mix_key, and
    partitions are dealt by it. The number of copies depends on the id, the seed and the source's rate alone, so a
    retried task repeats it and a rerun gives the same rows. A null source is a source of its own; a null id counts as
    the text "null"; null and empty texts have 0 characters; repeated rows get the same number of copies each. Columns
    named copy or mix_key are replaced. An empty table gives an empty result.

    Characters are summed with partial aggregation; the rates, a row a source, are written and joined, broadcast only
    if Spark finds the file small enough. The only shuffle of texts is the final one, by an even key.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rate = ws.save(rates(docs, weights, temperature, epochs, source_col, text_col, most_epochs).select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf")), "rates")
    who = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = docs.drop("copy", "mix_key").join(rate, F.col(source_col).eqNullSafe(F.col("__source")))
    below = lambda u: F.size(F.filter("__cdf", lambda c: c < u))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__parts")), F.lit(0), lambda n, j: n + below(uniform(F.lit(seed), who, j.cast("string"))))
    drawn = drawn.withColumn("__u", uniform(F.lit(seed), who)).withColumn("__n", below(F.col("__u")) + F.when(F.col("__parts") > 1, more).otherwise(0)).filter("__n > 0")
    copies = drawn.drop("__source", "__parts", "__cdf", "__u").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), who, F.col("copy").cast("string"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def op4(spark, sf_dir: str) -> DataFrame:
    """Every drawn copy of every document, sources tempered to the square root of their size."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "mix_key", "text")


def _unit_sql(parts: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{SEED}|' || {parts}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"


OP4_SQL = f"""
WITH RECURSIVE s AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY 1),
g AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) ELSE 0.0 END AS goal FROM s),
t AS (SELECT sum(size) AS all_size, sum(goal) AS all_goal FROM g),
w AS (SELECT source, CASE WHEN size > 0 THEN goal / all_goal * CAST(1.0 AS DOUBLE) * all_size / size ELSE 1.0 END AS whole FROM g, t),
r AS (SELECT source, greatest(1, CAST(ceil(whole / {PART}) AS INTEGER)) AS parts, whole / greatest(1, CAST(ceil(whole / {PART}) AS INTEGER)) AS rate FROM w),
c AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
l AS (SELECT source, list(c ORDER BY k) AS cdf FROM c GROUP BY 1),
d AS (SELECT d.doc_id, d.source, d.text, coalesce(CAST(d.doc_id AS VARCHAR), 'null') AS who, l.cdf, r.parts FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source JOIN r ON d.source IS NOT DISTINCT FROM r.source),
n AS (SELECT *, len(list_filter(cdf, lambda x: x < {_unit_sql("who")}))
  + CAST(coalesce(list_sum(list_transform(range(2, parts + 1), lambda j: len(list_filter(cdf, lambda x: x < {_unit_sql("who || '|' || j")})))), 0) AS BIGINT) AS n FROM d),
e AS (SELECT doc_id, source, text, who, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n)
SELECT doc_id, source, copy, md5('{SEED}|order|' || who || '|' || copy) AS mix_key, text FROM e
"""
