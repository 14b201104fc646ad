"""SimHash near-duplicates with pivot distance tables.

1. Each text gets a 64-bit majority fingerprint of its word shingles; equal fingerprints become one class.
2. Two fingerprints within ``radius`` bits leave at least BLOCKS - radius of BLOCKS bit blocks untouched, so every link
   has a bucket (a choice of blocks and their bits) in which both classes stand. Buckets over BUCKET classes are cut into
   chunks and every pair of chunks becomes a task of its own; no bucket is capped.
3. In a bucket, each fingerprint has a row of Hamming distances to PIVOTS reference fingerprints. By the triangle
   inequality a pair whose rows differ by more than ``radius`` in some coordinate is discarded; survivors are verified.
   A bucket gives a spanning star of each of its linked groups, not all its pairs.
4. Components over those links and over the classes that share an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, read, slices
from .components import components

BLOCKS, BUCKET, PIVOTS, HELD = 6, 4096, 16, 1_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SPREAD = _BITS.astype(np.uint8).view(np.uint64).ravel()
REFERENCES = np.random.default_rng(97).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the XXH64 (seed 42) values of the shingles; no words: 0; fewer than ``words``: one shingle."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens])
    k = min(words, len(tokens))
    starts = np.concatenate([[0], ends[:-1]])[: len(tokens) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros((8, 8), np.int64), len(starts)
    stops = (ends[k - 1 :] - 1).tolist()
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])], np.uint64)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(_WEIGHTS[(2 * counts.ravel()) > n].sum())


def majority(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits set in over half of the 64-bit hashes of each set; the sets stand one after another, begin at ``starts``, and none is empty."""
    sizes = np.diff(np.append(starts, len(h)))
    runs = -(-sizes // 255)  # one byte counts the ones of a bit over 255 hashes
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    ones = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], at)
    counts = np.add.reduceat(ones.view(np.uint8).reshape(-1, 64), first, dtype=np.int64)
    return (2 * counts > sizes[:, None]) @ _WEIGHTS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long) for every row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20):
                fps = np.array([fingerprint(t, words) for t in batch.column("t").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fps.view(np.int64))], names=["i", "fp"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, fp long").withColumnRenamed("i", id_col)


def block_masks(radius: int) -> list[int]:
    """The bit masks of all choices of BLOCKS - radius blocks, as signed 64-bit numbers."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _settled(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b have joined their groups; a label is the smallest index of its group."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        la, lb = la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def bucket_links(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row numbers) between fingerprints within ``radius`` of one bucket; rows come sorted by bucket."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ REFERENCES).astype(np.int8)
    labels, a, b, held = np.arange(n), [], [], 0
    at, step = np.arange(n), 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[bucket[at] == bucket[at + step]]
        near = at
        for p in range(PIVOTS):
            near = near[np.abs(table[near, p] - table[near + step, p]) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]
        if len(near):
            a.append(near)
            b.append(near + step)
            held += len(near)
            if held > HELD:
                labels, a, b, held = _settled(labels, np.concatenate(a), np.concatenate(b)), [], [], 0
    if a:
        labels = _settled(labels, np.concatenate(a), np.concatenate(b))
    rows = np.flatnonzero(labels != np.arange(n))
    return labels[rows], rows


def links(ws: Workspace, classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): spanning links between the representatives of classes (fp, rep) whose fingerprints are within ``radius``."""
    masks = block_masks(radius)
    keyed = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("fp", "rep", "x.c", "x.k")
    large = ws.save(keyed.groupBy("c", "k").count().filter(F.col("count") > BUCKET).select("c", "k", F.ceil(F.col("count") / (BUCKET // 2)).cast("int").alias("chunks")), "large")
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit("chunk")), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(mine, j) * 100000 + F.greatest(mine, j))
    cut = keyed.join(large, ["c", "k"], "left").select("fp", "rep", "c", "k", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(pairs)).alias("pair"))
    cut = cut.withColumn("bucket", F.xxhash64("c", "k", "pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        bucket, fps, reps = empty, empty, empty
        for batch in batches:
            bucket, fps, reps = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((bucket, "bucket"), (fps, "fp"), (reps, "rep")))
            if not len(bucket):
                continue
            full = int(np.searchsorted(bucket, bucket[-1]))
            if full:
                a, b = bucket_links(bucket[:full], fps[:full].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], names=["a", "b"])
                bucket, fps, reps = bucket[full:].copy(), fps[full:].copy(), reps[full:].copy()
        if len(bucket):
            a, b = bucket_links(bucket, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], names=["a", "b"])

    return cut.select("bucket", "fp", "rep").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, fp long, component_id): the smallest id reachable over fingerprints that differ in ``radius`` bits or fewer.

    The id column is a whole number. A null or empty text has the fingerprint 0 and links like any other. Rows that share
    an id are one document: an id with several texts links all their fingerprints. A row without an id keeps its
    fingerprint, takes part in no link and has a null component. Repeated rows each give a row. Extra columns are not
    looked at; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.save(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", words), "fps")
    known = fps.filter("id is not null")
    classes = ws.save(known.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    several = ws.save(known.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").select("id", "a"), "several")
    shared = known.join(several, "id").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()
    roots = components(ws, links(ws, classes.select("fp", F.col("fp").alias("rep")), radius).union(shared))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = ws.save(rooted.join(least, "root").select("fp", "component_id"), "placed")
    ws.drop("classes", "large", "several")
    return fps.join(placed, "fp", "left").select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
