"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size, each row into one. The task of a block sorts its list of each dimension
once; queries then stream past it in batches. A query reads its lists from their better ends, level by level; each row
met for the first time is scored at once. What the lists hold at the level reached bounds the score of every row not yet
met (at level 0 that is the block's extremes): as soon as that bound is below the kth score, the block is done.
A query first meets one block, its home. The kth score there is a floor for all other blocks, which it meets in a second
pass and often leaves sooner. Levels are read in doubling rounds so that each round is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, read

BLOCK, FIRST_LEVELS, SCALE = 8192, 32, 256


class Block:
    """Candidates with a list for each dimension, sorted once; ``scored`` counts the rows scored for queries so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.order, self.scored = ids, x, x.argsort(axis=0), 0
        self.exact = x.astype(float) if len(x) else x
        self.most = int(np.abs(x).max(initial=0))

    def best(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but ``own``, of those with a score of ``floor`` or more; ties go to the smaller id."""
        n, dims = len(self.ids), np.flatnonzero(query)
        wide = self.most * int(np.abs(query).max(initial=0)) * len(query) >= 1 << 52  # under that doubles are exact, and multiply faster
        x, order, query = (self.x, self.order, query) if wide else (self.exact, self.order, query.astype(float))
        weight, least = query[dims], -np.inf if floor is None else floor
        backward = weight > 0
        met = self.ids == own
        scored, score, level, step = met.copy(), np.zeros(n, x.dtype), 0, FIRST_LEVELS
        best = np.zeros(0, np.int64)
        while level < n:
            edge = np.where(backward, n - 1 - level, level)
            kth = score[best].min() if len(best) == k else least
            if (x[order[edge, dims], dims] * weight).sum() < max(kth, least):
                break
            until = min(n, level + step) if len(dims) else n
            met[order[level:until, dims[~backward]].ravel()] = True
            met[order[n - until : n - level, dims[backward]].ravel()] = True
            if until == n:
                met[:] = True  # without a dimension that counts all scores are 0
            new = np.flatnonzero(met & ~scored)
            score[new] = x[new] @ query
            scored[new] = True
            self.scored += len(new)
            pool = np.concatenate([best, new[score[new] >= max(kth, least)]])
            if len(pool) > k:
                pool = pool[score[pool] >= np.partition(score[pool], len(pool) - k)[len(pool) - k]]
            best = pool[np.lexsort((self.ids[pool], -score[pool]))[:k]]
            level, step = until, step * 2
            if scored.all():
                break
        return self.ids[best], score[best]


def _meet(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for each query sent there; both sides have (dims, c, id, v), asked also floor.

    A partition is sorted so that a block's candidates come before its queries; only a block and a batch of queries are held.
    """
    both = rows.select("dims", "c", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("floor")).union(asked.select("dims", "c", F.lit(1), "id", "v", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "c", "kind")], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                dims, c, kind = keys[lo].tolist()
                ids, x = batch.column("id").to_numpy()[lo:hi], batch.column("v").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dims)
                if (dims, c) != now:
                    now, held, block = (dims, c), [], None
                if kind == 0:
                    held.append((ids, x))
                    continue
                if block is None:
                    block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])) if held else Block(ids[:0], x[:0])
                    held = []
                out: list[list] = [[], [], []]
                for who, query, floor in zip(ids.tolist(), x, batch.column("floor").slice(lo, hi - lo).to_pylist()):
                    found, scores = block.best(query, who, k, floor)
                    out[0] += [who] * len(found)
                    out[1] += found.tolist()
                    out[2] += [int(s) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    return both.repartition("dims", "c").sortWithinPartitions("dims", "c", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on id_col) picks its k best others.

    Components become floor(scale * x); the score is the integer inner product. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part; a query meets vectors of its own length only. Rows that
    share an id count as one vector (the least). A query with fewer candidates gets them all; an empty table gives an
    empty result; extra columns are ignored. The number of blocks follows from one count; each holds about BLOCK
    candidates, dealt by a hash, so no task grows with the input or with equal vectors. A candidate is sent to one task
    in each pass, however many queries there are; a query is sent to every block.
    """
    ws = Workspace(vectors.sparkSession, "topk")
    fine = F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).filter(F.col("id").isNotNull() & fine)
    rows = ws.save(base.groupBy("id").agg(F.min(F.transform("e", lambda x: F.floor(x * scale))).alias("v")).withColumn("dims", F.size("v")), "rows")
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = rows.withColumnRenamed("id", id_col).filter(queries).withColumnRenamed(id_col, "id").withColumnRenamed("c", "home")
    home = ws.save(_meet(rows, asked.select("dims", F.col("home").alias("c"), "id", "v", F.lit(None).cast("long").alias("floor")), k), "home")
    floors = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("score") >= k, F.min("score")).alias("floor"))
    others = asked.join(floors, "id", "left").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("c != home")
    found = home.union(_meet(rows, others, k)) if blocks > 1 else home
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    """The five best others of every vector whose id is divisible by 50."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
