"""Substring dedup by seed and extend over word sequences.

Seeds: every window of ``window`` words picks the least-hashed SEED-word gram in it (leftmost on ties), so equal windows
pick equal anchors at equal places. Consecutive windows with one anchor form a span. Documents are joined on anchors;
anchors of one document only are dropped. A span that stands as a whole in an earlier document too is a copy (told by 64
bits of the anchor and 64 of the span), so a group of copies costs one row a copy, not one a pair.
Extend: what is left of an anchor with several distinct spans goes, as text, to the task of that anchor. From the anchor
the matches are walked word by word to the left and to the right: all spans that agree so far stay in one class, so the
walk is linear in their words. Spans in one class on the left after j words and on the right after window - SEED - j words
share a window; where the smallest id of such a class is smaller, the run of such windows is a maximal repeat with that
document, and its bytes are compared before it counts.
An anchor with over CROWD spans is dealt by more context first (pieces.uncrowd).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, identified, read, slices
from .pieces import PIECE, BodyWords, lists, numbers, uncrowd, whole_keys
from .textkernel import BASES, Rolling, Words, blocks, mixed, sliding_min

SEED, INDEX_BITS = 10, np.uint64(28)
SLICE, CROWD, CHUNK = 2 << 20, 256, 1 << 20


class Spans:
    """The spans of a batch of texts: begin (word of the batch), starts (windows in it), text, place (word of the text), inside (of the seed), seed, span."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts)
        values, text = self.words.hashes(), self.words.text_of_word()
        parts = [self._block(lo, values[lo:hi], text[lo:hi], window) for lo, hi in blocks(len(values), SLICE // 2, window)]
        self.begin, self.starts, self.inside, self.seed, self.span = (np.concatenate(c) for c in zip(*parts))
        self.text = text[self.begin]
        self.place = self.begin - self.words.first[self.text]

    def _block(self, lo: int, values: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Spans of the windows of the words from ``lo`` on."""
        n, seed = len(values), min(SEED, window)
        at = np.arange(max(0, n - window + 1))
        at = at[text[at] == text[at + window - 1]] if len(at) else at
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        here = np.arange(n - seed + 1)
        gram = Rolling(values, BASES[1]).of(here, here + seed)
        order = (gram >> INDEX_BITS << INDEX_BITS) | here.astype(np.uint64)
        chosen = (sliding_min(order, window - seed + 1)[at] & ((np.uint64(1) << INDEX_BITS) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
        first = np.flatnonzero(new)
        begin, starts = at[first], np.diff(np.append(first, len(at)))
        picked = chosen[first]
        span = mixed(Rolling(values, BASES[2]).of(begin, begin + starts - 1 + window) ^ ((picked - begin).astype(np.uint64) << np.uint64(40)))
        return begin + lo, starts, picked - begin, gram[picked].view(np.int64), span.view(np.int64)


def _walk(group: np.ndarray, words: np.ndarray, seat: np.ndarray, reach: np.ndarray, step: int, most: int) -> list[np.ndarray]:
    """For 0, 1, .. most words from ``seat`` on: the class of each row among those that agree so far, -1 beyond its reach."""
    out, top = [group], int(words.max(initial=0)) + 1
    for t in range(most):
        rows = np.flatnonzero(reach > t)
        now = np.full(len(group), -1)
        now[rows] = np.unique(out[-1][rows] * top + words[seat[rows] + step * t], return_inverse=True)[1]
        out.append(now)
    return out


def extend(h: np.ndarray, d: np.ndarray, n: np.ndarray, o: np.ndarray, bodies: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window) of the runs of windows of a row that a row of the same key and a smaller d holds too."""
    units, seed = BodyWords(bodies), min(SEED, window)
    group = np.unique(h, return_inverse=True)[1]
    first, most = units.first[:-1], window - seed
    seat, right = first + o, n - 1 + window - o - seed

    def runs(words: np.ndarray) -> tuple[np.ndarray, ...]:
        lefts, rights = _walk(group, words, seat - 1, o, -1, most), _walk(group, words, seat + seed, right, 1, most)
        found = [(np.zeros(0, np.int64),) * 3]
        for j in range(most + 1):
            rows = np.flatnonzero((lefts[j] >= 0) & (rights[most - j] >= 0))
            if not len(rows):
                continue
            which = np.unique(lefts[j][rows] * (len(h) + 1) + rights[most - j][rows], return_inverse=True)[1]
            order = np.lexsort((rows, d[rows], which))
            lead = order[np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1]]))][which]
            late = d[rows] > d[rows[lead]]
            found.append((rows[late], o[rows[late]] - j, rows[lead[late]]))
        row, at, by = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((at, row))
        row, at, by = row[order], at[order], by[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (by[1:] != by[:-1])
        a = np.flatnonzero(new)
        return row[a], at[a], at[np.append(a[1:], len(row)) - 1] if len(row) else at, by[a]

    row, lo, hi, by = runs(np.unique(units.values, return_inverse=True)[1])
    mine, other = first[row] + lo, first[by] + o[by] - o[row] + lo
    size = hi - lo + window
    if units.between(mine, mine + size) != units.between(other, other + size):  # two words share a hash: number the words by their bytes
        number: dict[bytes, int] = {}
        every = np.arange(len(units.values))
        row, lo, hi, by = runs(np.array([number.setdefault(w, len(number)) for w in units.between(every, every + 1)], np.int64))
    return row, lo, hi


def _covers(ws: Workspace, docs: DataFrame, window: int) -> DataFrame:
    """(d, v, cover array<struct<s, e>>): the word ranges of the document (d, v) that stand in a smaller id too."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                x = Spans(batch.column("t"), window)
                d, v = (batch.column(c).to_numpy()[x.text] for c in ("d", "v"))
                yield pa.RecordBatch.from_arrays([pa.array(x.seed), pa.array(x.span), pa.array(d), pa.array(v), pa.array(x.place.astype(np.int32))], names=["h", "sp", "d", "v", "s"])

    seen = ws.save(docs.mapInArrow(seeds, "h long, sp long, d long, v long, s int"), "seeds")
    by_seed = seen.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), (F.min("sp") == F.max("sp")).alias("one")).filter("lo < hi").select("h", "lo", "one")
    shared = ws.save(by_seed, "shared")
    ws.release()
    found = ws.save(seen.join(shared, "h").select("h", "sp", "d", "v", "s", F.when(F.col("one"), F.col("lo")).alias("lo")), "found")
    ws.drop("seeds", "shared")
    ws.release()
    several = found.filter("lo is null").drop("lo")
    first = ws.save(several.groupBy("h", "sp").agg(F.min("d").alias("lo")), "first")
    judged = several.join(first, ["h", "sp"]).select("d", "v", "s", "h", "sp", (F.col("d") > F.col("lo")).alias("whole"))
    judged = judged.union(found.filter("lo < d").select("d", "v", "s", "h", "sp", F.lit(True)))
    marks = ws.save(judged.groupBy("d", "v").agg(F.collect_list(F.struct("s", "h", "sp", "whole")).alias("marks")), "marks")
    ws.drop("found", "first")
    ws.release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each marked span its range (a copy) or its words."""
        for big in batches:
            for batch in slices(big, "t", SLICE):
                x = Spans(batch.column("t"), window)
                row, marks = lists(batch.column("marks"))
                at = np.searchsorted(x.text << 32 | x.place, row << 32 | numbers(marks, "s").astype(np.int64))
                h, sp, whole = (numbers(marks, c) for c in ("h", "sp", "whole"))
                if not ((x.text[at] == row) & (x.seed[at] == h) & (x.span[at] == sp)).all():
                    raise RuntimeError("a text changed between two reads of the input")
                d, v = (batch.column(c).to_numpy()[row] for c in ("d", "v"))
                raw = x.words.data.tobytes()
                begin, end = x.words.starts[x.begin[at]].tolist(), x.words.ends[x.begin[at] + x.starts[at] - 2 + window].tolist()
                body = [None if w else b" ".join(raw[a:b].split()) for a, b, w in zip(begin, end, whole.tolist())]
                columns = [pa.array(h), pa.array(d), pa.array(v), pa.array(x.place[at].astype(np.int32)), pa.array(x.starts[at].astype(np.int32)), pa.array(x.inside[at].astype(np.int32)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "d", "v", "s", "n", "o", "body"])

    parts = ws.save(docs.join(marks.hint("merge"), ["d", "v"]).mapInArrow(cut, PIECE), "parts")
    ws.drop("marks")
    ws.release()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, CHUNK):
            rows = rows.combine_chunks()
            h, d, v, s, n, o = (rows.column(c).to_numpy() for c in ("h", "d", "v", "s", "n", "o"))
            row, lo, hi = extend(h, d, n.astype(np.int64), o.astype(np.int64), rows.column("body").combine_chunks(), window)
            yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(v[row]), pa.array((s[row] + lo).astype(np.int32)), pa.array((s[row] + hi + window).astype(np.int32))], names=["d", "v", "s", "e"])

    pieces, covers = uncrowd(ws, parts.filter("body is not null"), BodyWords, window, ["d"], CROWD)
    covers.append(ws.save(pieces.repartition("h").sortWithinPartitions("h").mapInArrow(match, "d long, v long, s int, e int"), "matched"))
    every = parts.filter("body is null").select("d", "v", "s", (F.col("s") + F.col("n") - 1 + window).alias("e"))
    for c in covers:
        every = every.union(c)
    return every.groupBy("d", "v").agg(F.collect_list(F.struct("s", "e")).alias("cover"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Words are maximal runs of bytes other than space and 0x09-0x0D. Windows are judged on the input. Returns id_col,
    n_words, n_removed, spans (array of removed word ranges: start, n) and text (the kept words joined by one space).
    A null text has no words and becomes an empty text. Texts shorter than a window stay. Rows without an id are
    kept whole and take nothing from others; rows that share an id don't take from one another. Rows of one id and text
    are judged once and each give a row. Extra columns are ignored, an empty table gives an empty result. The windows of
    a text longer than SLICE are worked on in overlapping blocks.
    """
    ws = Workspace(docs.sparkSession, "substring")
    rows, documents, _ = identified(ws, docs, id_col, text_col)
    covers = _covers(ws, documents, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "t", SLICE):
                words, n = Words(batch.column("t")), batch.num_rows
                row, cover = lists(batch.column("cover"))
                depth = np.zeros(len(words) + 1, np.int64)
                raw = words.data.tobytes()
                if len(row):
                    np.add.at(depth, words.first[row] + numbers(cover, "s"), 1)
                    np.add.at(depth, words.first[row] + numbers(cover, "e"), -1)
                gone = np.cumsum(depth)[:-1] > 0
                texts, spans, removed = [], [], []
                for i in range(n):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    mine = gone[a:b]
                    removed.append(int(mine.sum()))
                    if not removed[-1]:
                        texts.append(b" ".join(raw[words.offsets[i] : words.offsets[i + 1]].split()))
                        spans.append([])
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    spans.append([{"start": s, "n": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    keep = np.flatnonzero(~mine) + a
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d"), pa.array(np.diff(words.first)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["d", "n_words", "n_removed", "spans", "text"],
                )

    out = rows.join(covers, ["d", "v"], "left").mapInArrow(cut, "d long, n_words long, n_removed long, spans array<struct<start:int,n:int>>, text string")
    return out.withColumnRenamed("d", id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    """Digest of what is left of every document."""
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
