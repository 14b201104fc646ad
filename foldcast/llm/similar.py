"""Near copies by SimHash with pivot distance tables and the Jaccard similarity of their word shingles.

1. A text is the set of 64-bit hashes of its runs of WORDS words; equal sets become one class, named by a hash of the set.
   A class has the 64-bit majority fingerprint of its set, so repeats in a text do not weigh.
2. Fingerprints within NEAR bits meet in the bit blocks of ``simhash.links``, whose pivot tables discard the other pairs.
3. Links of 0.8 mostly lie over NEAR bits apart, so most pairs come from bands: the least values of BANDS x ROWS hash functions over the set give
   BANDS keys, more buckets beside those of the bit blocks. Two sets of similarity s share a key with probability
   1 - (1 - s**ROWS)**BANDS, over 1 - 5e-8 from 0.8 on. Every class is compared with the least class of each of its
   buckets. Buckets whose classes are not all connected by then go to Python tasks, which compare whatever is still
   apart; buckets over BUCKET classes are cut into chunks and every pair of chunks becomes a task of its own. No bucket
   is capped.
4. Of all these pairs those whose fingerprints differ in over RADIUS bits are discarded, the others are verified on the
   sets themselves. Fingerprints of sets of similarity 0.8 differ in 64 * acos(8 / 9) / pi = 9.7 bits on average, in 12 for
   sets of 4 and 5, the worst case; the odds of over RADIUS are 4e-10 and 7e-8 (binomial).
5. Components over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Workspace, slices, worker
from .components import components
from .textkernel import BASES, Rolling, Words, mixed

WORDS, BANDS, ROWS, BUCKET = 5, 32, 4, 1024
NEAR, RADIUS = 3, 30
_random = np.random.default_rng(2004)
_TIMES = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def near(shared, a, b):
    """Have sets of a and b shingles, ``shared`` of them common, a similarity of 0.8 or more? In whole numbers."""
    return 9 * shared >= 4 * (a + b)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of one text after another, and n + 1 offsets; fewer than ``words`` words: one shingle."""
    w = Words(texts)
    w.data = _LOWER[w.data]
    text, at = w.text_of_word(), np.arange(len(w))
    end = np.minimum(at + words, w.first[text + 1])
    whole = (end - at == words) | (at == w.first[text])
    text, h = text[whole], Rolling(w.hashes(), BASES[1]).of(at[whole], end[whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(w.first)))


def band_keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys for each of the sets that begin at ``starts``; none of them is empty."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b, np.uint64)
        for r in range(ROWS):
            key = mixed(key * np.uint64(BASES[0]) + np.minimum.reduceat(h * _TIMES[b, r] + _PLUS[b, r], starts))
        out[:, b] = key
    return out


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _signed(texts: DataFrame) -> DataFrame:
    """(i, x, k, fp, bands) of (i, x, t): the class, its fingerprint, null for a text without words, and the band keys, none for such a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                h, offsets = shingle_sets(batch.column("t"))
                some = np.diff(offsets) > 0
                keys = band_keys(h, offsets[:-1][some]) if some.any() else np.zeros((0, BANDS), np.uint64)
                k = np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], np.uint64)
                bands = _lists(keys.ravel(), np.concatenate([[0], np.cumsum(some * BANDS)]))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("x"), pa.array(k.view(np.int64)), _fingerprints(h, offsets), bands], names=["i", "x", "k", "fp", "bands"])

    return texts.select("i", "x", "t").mapInArrow(worker("similar", run), "i long, x long, k long, fp long, bands array<long>")


def _fingerprints(h: np.ndarray, offsets: np.ndarray) -> pa.Array:
    some, fps = np.diff(offsets) > 0, np.zeros(len(offsets) - 1, np.uint64)
    if some.any():
        fps[some] = simhash.majority(h, offsets[:-1][some])
    return pa.array(fps.view(np.int64), mask=~some)


def _sets(texts: DataFrame) -> DataFrame:
    """(k, fp, s) of (k, t): the fingerprint and the shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                h, offsets = shingle_sets(batch.column("t"))
                yield pa.RecordBatch.from_arrays([batch.column("k"), _fingerprints(h, offsets), _lists(h, offsets)], names=["k", "fp", "s"])

    return texts.select("k", "t").mapInArrow(worker("similar", run), "k long, fp long, s array<long>")


def _close(ws: Workspace, classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that span the groups of fingerprints within NEAR bits; to be verified."""
    known = classes.filter("fp is not null")
    reps = ws.save(known.groupBy("fp").agg(F.min("k").alias("rep")), "reps")
    equal = known.join(reps, "fp").filter("k != rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    return equal.union(simhash.links(ws, reps, NEAR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def group_links(root: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that join the rows of one bucket as far as their sets are near; rows of one root are joined already."""
    n, fps = len(sizes), simhash.majority(shingles, np.cumsum(sizes) - sizes)
    _, label, counts = np.unique(root, return_inverse=True, return_counts=True)
    owner, order = np.repeat(np.arange(n), sizes), np.argsort(shingles, kind="stable")
    held, ranked = owner[order], shingles[order]
    ends, a, b = np.concatenate([[0], np.cumsum(sizes)]), [], []
    for i in np.flatnonzero(label != np.argmax(counts)):
        mine = shingles[ends[i] : ends[i + 1]]
        lo, hi = np.searchsorted(ranked, mine), np.searchsorted(ranked, mine, side="right")
        shared = np.bincount(np.concatenate([held[p:q] for p, q in zip(lo.tolist(), hi.tolist())]), minlength=n)
        found = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= RADIUS) & near(shared, sizes, sizes[i]) & (label != label[i]))
        if len(found):
            other, first = np.unique(label[found], return_index=True)
            a += [i] * len(first)
            b += found[first].tolist()
            label[np.isin(label, other)] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _open_links(ws: Workspace, members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes that share a bucket but no root yet; members is (bucket, k, centre, n)."""
    placed = members.filter("n > 2").join(roots, F.col("k") == F.col("node"), "left").select("bucket", "k", "n", F.coalesce("root", "k").alias("root"))
    placed = ws.save(placed, "placed")
    still = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    chunks = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
    mine = F.pmod(F.xxhash64(F.col("k"), F.lit("chunk")), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(mine, j) * 100000 + F.greatest(mine, j))
    cut = placed.join(still, "bucket").select("k", "root", "bucket", F.explode(F.when(F.col("n") > BUCKET, pairs).otherwise(F.array(F.lit(-1)))).alias("pair"))
    cut = cut.select("k", "root", F.xxhash64("bucket", "pair").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            k, root = (rows[c].to_numpy() for c in ("k", "root"))
            s = rows["s"].combine_chunks()
            a, b = group_links(root, s.value_lengths().to_numpy().astype(np.int64), s.flatten().to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(k[a]), pa.array(k[b])], names=["a", "b"])

        now, parts = None, []
        for batch in batches:
            task = batch.column("task").to_numpy()
            edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if parts and task[lo] != now:
                    yield linked(parts)
                    parts = []
                now = task[lo]
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield linked(parts)

    dealt = cut.join(sets.select("k", "s"), "k").select("task", "k", "root", "s").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(worker("similar", run), "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies of other rows: of each component the text with the smallest id stays; columns as they were.

    Texts are near if their sets of five-word shingles (ASCII letters in lower case) have a Jaccard similarity of 0.8 or
    more; texts without words are near to each other only. The id column is a whole number. Rows without an id stay and
    take part in no link. Rows of one id and text are one document, of which one row stays (the least by its columns);
    rows of one id and other texts are told apart by a hash of their text. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "similar")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("x"), text.alias("t")).filter("i is not null")
    rows = ws.save(_signed(texts), "rows")
    first = rows.groupBy("k").agg(F.min(F.struct("i", "x")).alias("m")).select("k", "m.i", "m.x")
    classes = ws.save(rows.join(first, ["k", "i", "x"]), "classes")
    keyed = classes.select("k", F.explode("bands").alias("bucket"))
    shared = ws.save(keyed.groupBy("bucket").agg(F.min("k").alias("centre"), F.max("k").alias("last"), F.count("k").alias("n")).filter("centre < last").drop("last"), "shared")
    members = ws.save(keyed.join(shared, "bucket").select("bucket", "k", "centre", "n"), "members")
    ws.release()
    close = ws.save(_close(ws, classes), "close")
    ws.drop("reps", "large")
    ws.release()
    need = classes.select("k", "i", "x").join(members.select("k").union(close.select("a")).union(close.select("b")).distinct(), "k", "left_semi")
    sets = ws.save(_sets(texts.join(need.hint("shuffle_hash"), ["i", "x"])), "sets")
    ws.release()
    pairs = members.filter("k != centre").select(F.col("centre").alias("a"), F.col("k").alias("b")).union(close).distinct()
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("fp").alias("fa"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("fp").alias("fb"), F.col("s").alias("sb")), "b")
    both = both.filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS)
    star = ws.save(both.filter(near(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b"), "star")
    rest = ws.save(_open_links(ws, members, components(ws, star, "star-cc"), sets), "rest")
    ws.drop("members", "shared", "close", "placed", "sets")
    ws.release()
    roots = components(ws, star.union(rest))
    rooted = classes.join(roots, F.col("k") == F.col("node"), "left").select("k", F.struct("i", "x").alias("m"), F.coalesce("root", "k").alias("root"))
    kept = ws.save(rooted.groupBy("root").agg(F.min("m").alias("kept")).join(rooted.select("k", "root"), "root").select("k", "kept.i", "kept.x").distinct(), "kept")
    stay = kept.select("k", F.col("i").alias("ki"), F.col("x").alias("kx"))
    gone = ws.save(rows.select("i", "x", "k").join(stay, "k").filter("i != ki or x != kx").select(F.col("i").alias("__i"), F.col("x").alias("__x")).distinct(), "gone")
    again = ws.save(rows.groupBy(F.col("i").alias("__i"), F.col("x").alias("__x")).count().filter("count > 1").drop("count"), "again")
    ws.drop("rows", "classes", "kept")
    at = lambda other: (F.col(id_col).cast("long") == other["__i"]) & (F.xxhash64(text) == other["__x"])
    stay = docs.join(gone.hint("shuffle_hash"), at(gone), "left_anti")
    if again.isEmpty():
        return stay
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = stay.join(again, at(again), "left_semi").groupBy(F.col(id_col).cast("long").alias("__i"), F.xxhash64(text).alias("__x")).agg(F.min(whole).alias("__row"))
    return stay.join(again, at(again), "left_anti").union(one.select("__row.*"))
