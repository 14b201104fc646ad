"""Pieces of texts dealt by a key: cutting crowded keys by more context, and reading whole keys in a task.

A piece is a row (h, d, v, s, n, o, body): ``body`` holds n strings of ``width`` units (bytes or words) of the document
(d, v), the first of which starts at unit s of its text; a seed that all of them hold stands o units after the body's
start. Only strings of one key h need be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, flat_bytes, slices
from .textkernel import BASES, BYTE_VALUE, Rolling, Words, mixed

PIECE = "h long, d long, v long, s int, n int, o int, body binary"


class Bytes:
    """The units of a column of bodies are their bytes."""

    def __init__(self, bodies: pa.Array):
        data, self.first = flat_bytes(bodies)
        self.values, self.raw = BYTE_VALUE[data], data.tobytes()

    def between(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]


class BodyWords:
    """The units are words, which one space parts."""

    def __init__(self, bodies: pa.Array):
        self.words = Words(bodies)
        self.first, self.values, self.raw = self.words.first, self.words.hashes(), self.words.data.tobytes()

    def between(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.words.starts[begin].tolist(), self.words.ends[end - 1].tolist())]


def offset_ranges(width: int, step: int) -> list[tuple[int, int]]:
    """The offsets of a seed in a string, cut into ranges of ``step``."""
    return [(near, min(near + step, width) - 1) for near in range(0, width, step)]


def finer(h: np.ndarray, n: np.ndarray, o: np.ndarray, units, width: int, step: int) -> tuple[np.ndarray, ...]:
    """(row, key, first string, strings, seed's offset, body): a piece for each range of offsets that a row has strings in.

    The key is made of what all strings of the range hold around the seed.
    """
    rolling, out = Rolling(units.values, BASES[1]), []
    for near, far in offset_ranges(width, step):
        begin, end = np.maximum(0, o - far), np.minimum(n - 1, o - near)
        rows = np.flatnonzero(begin <= end)
        seat = units.first[rows] + o[rows]
        key = mixed(rolling.of(seat - near, seat - far + width) ^ mixed(h[rows].view(np.uint64) + np.uint64(near)))
        begin, end = begin[rows], end[rows]
        body = np.array([*units.between(units.first[rows] + begin, units.first[rows] + end + width), None], object)[:-1]
        out.append((rows, key.view(np.int64), begin, end - begin + 1, o[rows] - begin, body))
    return tuple(np.concatenate(c) for c in zip(*out))


def uncrowd(ws: Workspace, pieces: DataFrame, units, width: int, order: list[str], most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces of which at most about ``most`` share a key, and the covers (d, v, s, e) of those that proved to be copies on the way.

    Pieces of a crowded key are cut into finer ranges, down to single strings. Of equal pieces (compared as bytes) all that
    are later than the first in ``order`` are copies of it; keys with one body left need no more work. Counts and minima
    are pre-aggregated, and copies meet the first in a join between two shuffled scans.
    """
    calm, covers, step, rank = [], [], width, F.struct(*order)
    while True:
        crowded = ws.save(pieces.groupBy("h").count().filter(F.col("count") > most).select("h"), f"crowded-{step}")
        if step == 1 or crowded.isEmpty():
            break
        calm.append(pieces.join(crowded, "h", "left_anti"))
        step = max(1, step // 6)

        def cut(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "body", 1 << 20):
                    h, d, v, s, n, o = (batch.column(c).to_numpy() for c in ("h", "d", "v", "s", "n", "o"))
                    row, key, first, many, inside, body = finer(h, n.astype(np.int64), o.astype(np.int64), units(batch.column("body")), width, step)
                    columns = [pa.array(key), pa.array(d[row]), pa.array(v[row]), pa.array((s[row] + first).astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(inside.astype(np.int32)), pa.array(body.tolist(), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "d", "v", "s", "n", "o", "body"])

        fine = ws.save(pieces.join(crowded, "h").select(pieces.columns).mapInArrow(cut, PIECE), f"fine-{step}")
        first = ws.save(fine.groupBy("h", "body").agg(F.min(rank).alias("first")), f"first-{step}")
        judged = ws.save(fine.join(first, ["h", "body"]).withColumn("later", rank > F.col("first")).select(*pieces.columns, "later"), f"judged-{step}")
        ws.drop(f"fine-{step}")
        covers.append(judged.filter("later").select("d", "v", "s", (F.col("s") + F.col("n") - 1 + width).alias("e")))
        several = ws.save(first.groupBy("h").count().filter("count > 1").select("h"), f"several-{step}")
        pieces = ws.save(judged.filter("not later").join(several, "h").select(pieces.columns), f"pieces-{step}")
    for c in calm:
        pieces = pieces.union(c)
    return pieces, covers


def whole_keys(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Runs of rows of about ``size`` bytes that hold all pieces of their keys; rows come sorted by key."""

    def cut(rows: pa.Table) -> list[pa.Table]:
        key = rows.column("h").to_numpy()
        edges = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        many, out, lo = max(1, size * len(key) // max(1, rows.nbytes)), [], 0  # rows of about ``size`` bytes
        while lo < len(key):
            hi = int(edges[min(np.searchsorted(edges, lo + many), len(edges) - 1)])
            out.append(rows.slice(lo, hi - lo))
            lo = hi
        return out

    held, have = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            have += batch.nbytes
        if have >= 2 * size:
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column("h").to_numpy()
            done = int(np.searchsorted(key == key[-1], True))  # the last key may go on
            yield from cut(rows.slice(0, done))
            held, have = rows.slice(done).to_batches(), 0
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks())


def lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """For each entry of a column of lists the row it stands in, and the entries."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def numbers(column: pa.Array, name: str) -> np.ndarray:
    return column.field(name).to_numpy(zero_copy_only=False)
