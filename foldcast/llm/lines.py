"""Line dedup over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, d, k, pos): a row for each window; two 64-bit hashes chained over its lines."""
    lines = docs.filter("d is not null").select("d", F.xxhash64("t").alias("k"), F.split("t", "\n").alias("lines")).filter(F.size("lines") >= WINDOW)

    def hashed(i: Column) -> Column:
        part = [F.col("lines")[i + j] for j in range(WINDOW)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("second"), *part).alias("h2"))

    each = lines.select("d", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), hashed)).alias("pos", "w"))
    return each.select("w.h1", "w.h2", "d", "k", "pos")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of the text, and n_lines and n_removed.

    Lines are what stands between newlines, compared exactly. A window is three consecutive lines; a window that also
    starts earlier (smaller id, or the same document further up) is a later occurrence, and every line that a later
    occurrence covers goes. Texts of under three lines stay. A null text stays null with 0 lines, an empty text has one
    line. Rows without an id are kept whole and take nothing from others. Rows of one id and text are one document;
    rows of one id and other texts are told apart by their text. Columns named n_lines or n_removed are replaced.
    An empty table gives an empty result.

    Windows are pre-aggregated before they are shuffled; occurrences meet the first one in a join between two shuffled
    scans, which adaptive execution splits where a window is very common. The texts meet their covered windows in a join
    that builds its table from the windows, so texts are neither sorted nor held. The plan is one query without written
    tables: a lost executor costs the stages whose shuffle files it held.
    """
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    windows = _windows(base)
    where = F.struct("d", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first < last").select("h1", "h2", "first")
    later = windows.join(repeated.hint("merge"), ["h1", "h2"]).filter(where > F.col("first"))
    covered = later.groupBy("d", "k").agg(F.collect_set("pos").alias("at"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col])  # so that no name of an input column clashes
    whole = docs.select(rest.alias("row"), F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    joined = whole.join(covered.hint("shuffle_hash"), ["d", "k"], "left").select("row", "text", "at", F.when(F.col("text").isNull(), 0).otherwise(n).alias("n"))
    gone = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + WINDOW - 1))))
    marked = joined.select("row", "text", "n", F.when(F.col("at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.col("n") - 1), gone)).alias("kept"))
    without = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform("kept", lambda i: F.element_at(lines, i + 1)), "\n"))
    new = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.element_at(without, 1))
    shown = [new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns]
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept"))
    return marked.select(*shown, F.col("n").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM d WHERE len(ls) >= 3),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY ls[pos], ls[pos + 1], ls[pos + 2] ORDER BY doc_id, pos) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, pos + o AS line FROM k, (VALUES (0), (1), (2)) v(o) WHERE nth > 1),
l AS (SELECT doc_id, unnest(ls) AS s, unnest(range(1, len(ls) + 1)) AS line FROM d),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) AS text, count(*) AS n FROM l LEFT JOIN gone USING (doc_id, line) WHERE gone.line IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.ls), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (doc_id)
"""
