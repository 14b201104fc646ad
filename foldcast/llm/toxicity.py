"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first 4, 5 and 6 bytes, each hashed into one of 2**BITS buckets and
counted once a text. The machine is score = sigmoid(bias + sum of weights + sum over pairs of buckets of the product of
their vectors), so a pair such as an insult and a group mention can count where its parts do not.
Training takes at most ROWS labelled texts of each label (the least by a hash of the id) and at most HELD bucket entries.
First a machine over all buckets is fitted by mini-batches, once to the labels and once to shuffled labels: a bucket
whose vector, times the root of the number of its texts, exceeds all that the shuffled labels bring about has a meaning,
alone or in a pair; the others are noise. Then the machine of those buckets is fitted anew. No term is left out for
telling nothing by itself, and no number of terms is set. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, flat_bytes, held_out, read, slices, worker
from .textkernel import BASES, BYTE_VALUE, Rolling

ROWS, HELD, BITS, FACTORS = 5000, 1 << 23, 20, 8
THRESHOLD, PREFIXES, SLICE = 0.3, (4, 5, 6), 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (row, term hash) arrays, one for each kind of term; a term may come more than once."""
    data, offsets = flat_bytes(texts)
    inside = _LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    rolling = Rolling(BYTE_VALUE[_LOWER[data]], BASES[0])
    yield row, rolling.of(starts, ends)
    for n in PREFIXES:
        long = ends - starts > n
        yield row[long], rolling.of(starts[long], starts[long] + n)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the terms of each text, each bucket once, in order."""
    keys = [row.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64) for row, h in terms(texts)]
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Machine:
    """A fitted machine; its buckets are sorted."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``buckets``) of the machine's buckets in the texts, each once."""
        place = np.full(1 << BITS, -1, np.int64)
        place[self.buckets] = np.arange(len(self.buckets))
        many, keys = max(1, len(self.buckets)), [np.zeros(0, np.int64)]
        for row, h in terms(texts):
            at = place[(h >> np.uint64(64 - BITS)).astype(np.int64)]
            keys.append(row[at >= 0] * many + at[at >= 0])
        key = np.unique(np.concatenate(keys))
        return key // many, key % many

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of each text the sigmoid of bias, weights and, by the square of the sum, all pairs of different buckets."""
        row, term = self.found(texts)
        n = len(texts)
        z = self.bias + np.bincount(row, self.weights[term], n)
        for v in self.factors.T:
            z += (np.bincount(row, v[term], n) ** 2 - np.bincount(row, v[term] ** 2, n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def explore(ends: np.ndarray, ids: np.ndarray, y: np.ndarray, share: float, epochs: int = 4, batch: int = 64, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """How far the vector of each bucket stands out in a machine over all of them: its length times the root of its number of texts.

    Row i has the buckets ids[ends[i]:ends[i + 1]]. Mini-batches with a step for each number by its past gradients.
    """
    rng, size = np.random.default_rng(11), 1 << BITS
    importance = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    bias, weights, factors = np.log(share / (1 - share)), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    past_w, past_v = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in (order[i : i + batch] for i in range(0, len(order), batch)):
            n, many = len(rows), ends[rows + 1] - ends[rows]
            row = np.repeat(np.arange(n), many)
            own, at = np.unique(ids[np.arange(len(row)) + np.repeat(ends[rows] - (np.cumsum(many) - many), many)], return_inverse=True)
            v, w = factors[own], weights[own]
            x = v[at]
            s = np.stack([np.bincount(row, x[:, f], n) for f in range(FACTORS)], 1)
            z = bias + np.bincount(row, w[at], n) + ((s * s).sum(1) - np.bincount(row, (x * x).sum(1), n)) / 2
            error = importance[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows])
            each = error[row]
            total = np.bincount(at, each, len(own))
            step_w = total / n + decay * w
            step_v = (np.stack([np.bincount(at, each * s[row, f], len(own)) for f in range(FACTORS)], 1) - total[:, None] * v) / n + decay * v
            past_w[own] += step_w * step_w
            past_v[own] += step_v * step_v
            weights[own] = w - rate * step_w / np.sqrt(past_w[own])
            factors[own] = v - rate * step_v / np.sqrt(past_v[own])
            bias -= 0.05 * error.mean()
    return np.sqrt((factors.astype(float) ** 2).sum(1) * np.bincount(ids, minlength=size))


def choose(ends: np.ndarray, ids: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """The buckets that stand out further than any bucket does where the labels are shuffled."""
    noise = explore(ends, ids, np.random.default_rng(5).permutation(y), share).max()
    return np.flatnonzero(explore(ends, ids, y, share) > noise)


def fit_machine(x: np.ndarray, y: np.ndarray, share: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss of a 0/1 matrix; labels are weighted so that label 1 has the given share. Equal rows are taken together."""
    rng = np.random.default_rng(11)
    n, m = x.shape
    importance = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean())) / n
    _, kept, which = np.unique(np.packbits(np.column_stack([x, y]).astype(bool), axis=1), axis=0, return_index=True, return_inverse=True)
    x, y, importance = x[kept], y[kept], np.bincount(which.ravel(), importance)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(m), rng.normal(0, 0.05, (m, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        b, w, v = params
        s = x @ v.astype(np.float32)
        z = b[0] + x @ w.astype(np.float32) + (np.square(s).sum(1) - x @ np.square(v).sum(1).astype(np.float32)) / 2
        error = (importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        total = x.T @ error
        grads = [np.array([error.sum()]), total + decay * w, x.T @ (error[:, None] * s) - total[:, None] * v + decay * v]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from labelled rows that are not held out; a null id, text or label teaches nothing, of several labels the highest counts.

    Without rows of both labels the machine has no buckets and gives every text the share of label 1 (0 without labels).
    Of the texts chosen, those that come last by the hash are left out if all of them had over HELD entries.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    marked = labels.select(F.col(id_col).cast("long").alias("d"), F.col(label_col).cast("int").alias("y")).filter("d is not null and y in (0, 1)").filter(~held_out("d")).groupBy("d").agg(F.max("y").alias("y"))
    n = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    empty = Machine(np.zeros(0, np.int64), float(np.log(max(share, 1e-4) / max(1 - share, 1e-4))), np.zeros(0), np.zeros((0, FACTORS)))
    if len(n) < 2:
        return empty
    order = F.xxhash64("d", F.lit("toxicity"))
    chosen = marked.filter("y = 1").orderBy(order).limit(ROWS).union(marked.filter("y = 0").orderBy(order).limit(ROWS))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).filter("t is not null").join(F.broadcast(chosen), "d").groupBy("d").agg(F.max("t").alias("t"), F.max("y").alias("y")).select(order.alias("o"), "t", "y")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                row, bucket = buckets(batch.column("t"))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32)))], names=["o", "y", "terms"])

    rows = ws.save(texts.mapInArrow(worker("toxicity", entries), "o long, y int, terms array<int>"), "rows")
    sizes = rows.select("o", F.size("terms").alias("n")).toPandas().sort_values("o")
    last = sizes.o[sizes.n.cumsum() <= HELD].max() if len(sizes) else 0
    table = rows.filter(F.col("o") <= F.lit(int(last))).toArrow().sort_by("o")
    ws.close()
    lists, y = table.column("terms").combine_chunks(), table.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return empty
    ends, ids = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), lists.flatten().to_numpy().astype(np.int64)
    kept = choose(ends, ids, y, share)
    if not len(kept):
        return empty
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    at, row = place[ids], np.repeat(np.arange(len(y)), np.diff(ends))
    x = np.zeros((len(y), len(kept)), np.float32)
    x[row[at >= 0], at[at >= 0]] = 1
    return Machine(kept, *fit_machine(x, y, share))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with score (double, 0 to 1) and predicted (int, 1 from THRESHOLD on); one pass, no shuffle.

    A null text is scored as an empty one. Repeated rows each give a row. Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                s = machine.scores(batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(worker("toxicity", run), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = read(spark, sf_dir, "documents")
    machine = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
