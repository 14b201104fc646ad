"""Suffix-array dedup of byte strings by the difference-cover algorithm.

Equal strings of ``length`` bytes pick the same seed in them (the least-hashed SEED-byte gram, leftmost on ties), so the
work is dealt by seed: strings of different seeds need not be compared. A run of strings with one seed is a span. Spans
that stand elsewhere as a whole are copies of their first occurrence (told by 64 bits of the seed and 64 of the span);
the distinct spans of a seed that has several go, as bytes, to the task of that seed. Each task builds a suffix array
over its spans by the difference cover modulo 3: sort the sampled triples, recurse on their names, merge the remaining
suffixes, then compare adjacent prefixes of ``length`` bytes; every start but the earliest of a group of equal prefixes
is a repeat.

A seed with over CROWD distinct spans is dealt by more context: its strings are cut by their offset to the seed into
ranges, and each range of a span becomes a piece whose key is the bytes around the seed that all its strings hold. Equal
pieces (compared as bytes) become one representative and copies; what is still crowded is cut into finer ranges, down to
single strings, of which all that share a key are equal. So no task grows with one seed, and every route ends the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, flat_bytes, identified, read, slices
from .pieces import PIECE, Bytes, lists, numbers, offset_ranges, uncrowd, whole_keys
from .textkernel import BASES, BYTE_VALUE, Rolling, blocks, mixed, sliding_min

SEED, INDEX_BITS, SLICE = 24, np.uint64(28), 1 << 20
CROWD, CHUNK = 256, 1 << 19


class ByteSpans:
    """The spans of a batch of texts: begin (byte of the batch), starts (strings in it), text, place (byte of the text), inside (of the seed), seed, span."""

    def __init__(self, texts: pa.Array, length: int):
        self.data, self.offsets = flat_bytes(texts)
        parts = [self._block(lo, hi, length) for lo, hi in blocks(len(self.data), SLICE, length)]
        self.begin, self.starts, self.inside, self.seed, self.span = (np.concatenate(c) for c in zip(*parts))
        self.text = np.searchsorted(self.offsets, self.begin, side="right") - 1
        self.place = self.begin - self.offsets[self.text]

    def _block(self, lo: int, hi: int, length: int) -> tuple[np.ndarray, ...]:
        """Spans of the strings that lie in the bytes [lo, hi)."""
        data, offsets = self.data[lo:hi], np.unique(np.clip(self.offsets, lo, hi) - lo)
        n, seed = len(data), min(SEED, length)
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(max(0, n - length + 1))
        at = at[text[at] == text[at + length - 1]] if len(at) else at
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        values = BYTE_VALUE[data]
        here = np.arange(n - seed + 1)
        gram = Rolling(values, BASES[1]).of(here, here + seed)
        order = (gram >> INDEX_BITS << INDEX_BITS) | here.astype(np.uint64)
        chosen = (sliding_min(order, length - seed + 1)[at] & ((np.uint64(1) << INDEX_BITS) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
        first = np.flatnonzero(new)
        begin, starts = at[first], np.diff(np.append(first, len(at)))
        picked = chosen[first]
        span = mixed(Rolling(values, BASES[2]).of(begin, begin + starts - 1 + length) ^ ((picked - begin).astype(np.uint64) << np.uint64(40)))
        return begin + lo, starts, picked - begin, gram[picked].view(np.int64), span.view(np.int64)


def _packed(parts: list[np.ndarray], top: int) -> np.ndarray:
    """One 64-bit key for up to three columns of numbers below ``top`` that sorts as the columns do."""
    bits = max(1, int(top).bit_length())
    if bits * len(parts) > 63:
        order = np.lexsort(parts[::-1])
        rows = np.stack(parts, 1)[order]
        new = np.ones(len(rows), np.int64)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        out = np.empty(len(rows), np.int64)
        out[order] = np.cumsum(new)
        return out
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = key << bits | p
    return key


def ranks(s: np.ndarray, depth: float = np.inf) -> np.ndarray:
    """Dense ranks of the suffixes of s (whole numbers from 0), in the order of their first ``depth`` elements at least.

    With depth unbounded the ranks are the inverse of the suffix array.
    """
    n = len(s)
    top = int(s.max()) + 1 if n else 1
    c = np.zeros(n + 3, np.int64)
    c[:n] = s + 1
    if n < 4:
        keys = [tuple(c[i:n]) for i in range(n)]
        place = {k: r for r, k in enumerate(sorted(set(keys)))}
        return np.array([place[k] for k in keys], np.int64)
    # Sort the sampled triples and name them.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    c = np.append(c, 0)
    _, names = np.unique(_packed([c[sample], c[sample + 1], c[sample + 2]], top + 1), return_inverse=True)
    # Recurse on the names until they differ, or reach as deep as is asked.
    if depth > 3 and names.max() + 1 < len(sample):
        names = ranks(names, np.ceil(depth / 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names + 1
    rank[n:] = 0
    # Merge the remaining suffixes: count the smaller ones of each class.
    zero = np.arange(0, n, 3)
    limit = max(top, len(sample)) + 2
    pair = lambda i: _pair(c[i], rank[i + 1], limit)
    own = pair(zero)
    order = np.argsort(sample_rank := rank[sample], kind="stable")
    by_rank = sample[order]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    ones, twos = ones[ones < n], twos[twos < n]
    pair_ones = pair(ones)
    wide = limit.bit_length() * 3 > 63
    if wide:
        both = _packed([np.concatenate([c[zero], c[twos]]), np.concatenate([c[zero + 1], c[twos + 1]]), np.concatenate([rank[zero + 2], rank[twos + 2]])], limit)
        triple_zero, triple_twos = both[: len(zero)], both[len(zero) :]
    else:
        triple_zero, triple_twos = (_packed([c[i], c[i + 1], rank[i + 2]], limit) for i in (zero, twos))
    # A total preorder over all suffixes: sampled ones by rank, the others between the sampled ones they fall between.
    rising = np.argsort(own, kind="stable")  # looking up nearly sorted keys walks memory in order

    def places(keys, wanted, side):
        out = np.empty(len(wanted), np.int64)
        out[rising] = np.searchsorted(keys, wanted[rising], side=side)
        return out

    below_one, upto_one = places(pair_ones, own, "left"), places(pair_ones, own, "right")
    below_two, upto_two = places(triple_twos, triple_zero, "left"), places(triple_twos, triple_zero, "right")
    sorted_rank = sample_rank[order]
    inside = by_rank < n
    sorted_rank = sorted_rank[inside]
    distinct, tie = np.unique(sorted_rank, return_inverse=True)
    rank_one, rank_two = tie[by_rank[inside] % 3 == 1], tie[by_rank[inside] % 3 == 2]
    # Twice the rank of an equal sampled suffix, or the odd number between its neighbours.
    place = np.full(n, -1, np.int64)
    place[by_rank[inside]] = 2 * tie
    above = np.maximum(np.where(below_one > 0, rank_one[below_one - 1] if len(rank_one) else -1, -1), np.where(below_two > 0, rank_two[below_two - 1] if len(rank_two) else -1, -1))
    slot = 2 * above + 1
    equal_one, equal_two = upto_one > below_one, upto_two > below_two
    if len(rank_two):
        slot = np.where(equal_two, 2 * rank_two[np.minimum(below_two, len(rank_two) - 1)], slot)
    if len(rank_one):
        slot = np.where(equal_one, 2 * rank_one[np.minimum(below_one, len(rank_one) - 1)], slot)
    place[zero] = slot
    among = np.zeros(n, np.int64)
    among[zero[rising]] = np.cumsum(np.concatenate([[False], own[rising][1:] != own[rising][:-1]]))
    among[place % 2 == 0] = 0
    _, out = np.unique(_packed([place, among], 2 * len(distinct) + n + 2), return_inverse=True)
    return out


def _pair(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    return a << int(top).bit_length() | b


def shared_parts(bodies: list[bytes], starts: np.ndarray, inside: np.ndarray, seeds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first start, starts) of the pieces that may hold a string of another one; the rest are told by less.

    The seed stands at some offset in a string. All strings with offsets in one of a few ranges share the bytes around
    the seed that each of them must hold; if no other piece of the seed has these bytes, none of those strings repeats.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    base = np.cumsum(sizes) - sizes
    rolling = Rolling(BYTE_VALUE[data], BASES[1])
    step = max(1, min(13, length // 4))
    low, high = np.full(len(bodies), 1 << 40), np.full(len(bodies), -1)
    for near, far in offset_ranges(length, step):
        begin, end = np.maximum(0, inside - far), np.minimum(starts - 1, inside - near)  # starts whose offset is in the range
        rows = np.flatnonzero(begin <= end)
        if not len(rows):
            continue
        seat = base[rows] + inside[rows]
        key = rolling.of(seat - near, seat - far + length) ^ mixed(seeds[rows].view(np.uint64).copy())
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        rows = rows[count[which] > 1]
        low[rows], high[rows] = np.minimum(low[rows], begin[rows]), np.maximum(high[rows], end[rows])
    kept = np.flatnonzero(high >= 0)
    return kept, low[kept], high[kept] - low[kept] + 1


def repeats(pieces: list[bytes], starts: np.ndarray, ids: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start in it) of every string of ``length`` bytes that also starts earlier, by (id, place + start).

    Piece i has starts[i] strings and len = starts[i] - 1 + length bytes.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(sizes) - sizes
    text = np.zeros(len(data) + len(pieces), np.int64)  # a 0 after each piece
    shift = np.repeat(np.arange(len(pieces)), sizes)
    text[np.arange(len(data)) + shift] = data.astype(np.int64) + 1
    ends = np.cumsum(starts)
    piece = np.repeat(np.arange(len(pieces)), starts)
    start = np.arange(ends[-1]) - np.repeat(ends - starts, starts)
    at = base[piece] + start
    order = np.argsort(ranks(text, length)[at + piece], kind="stable")
    at, piece, start = at[order], piece[order], start[order]
    same = np.ones(len(at) - 1, bool)  # compare adjacent prefixes, eight bytes at a time
    if len(at) > 1:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.zeros(len(data), np.uint64)
        for b in range(8):
            words |= padded[b : b + len(data)].astype(np.uint64) << np.uint64(8 * b)
        steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
        for step in steps:
            same &= words[at[1:] + step] == words[at[:-1] + step]
        if not steps:
            for step in range(length):
                same &= data[at[1:] + step] == data[at[:-1] + step]
    group = np.concatenate([[0], np.cumsum(~same)])
    rows = np.lexsort((places[piece] + start, ids[piece], group))
    g, d, p = group[rows], ids[piece][rows], (places[piece] + start)[rows]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    lead = np.repeat(first, np.diff(np.append(first, len(g))))
    later = (d != d[lead]) | (p != p[lead])
    return piece[rows][later], start[rows][later]


def _covers(ws: Workspace, docs: DataFrame, many: bool, length: int) -> DataFrame:
    """(d, v, cover array<struct<s, e>>): byte ranges of the document (d, v) that repeat something earlier."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                x = ByteSpans(batch.column("t"), length)
                d, v = (batch.column(c).to_numpy()[x.text] for c in ("d", "v"))
                yield pa.RecordBatch.from_arrays([pa.array(x.seed), pa.array(x.span), pa.array(d), pa.array(v), pa.array(x.place.astype(np.int32))], names=["h", "sp", "d", "v", "s"])

    seen = ws.save(docs.mapInArrow(seeds, "h long, sp long, d long, v long, s int"), "seeds")
    shared = ws.save(seen.groupBy("h").count().filter("count > 1").select("h"), "shared")
    ws.release()
    found = ws.save(seen.join(shared.hint("merge"), "h"), "found")
    ws.drop("seeds", "shared")
    ws.release()
    where = F.struct("d", "s")
    first = ws.save(found.groupBy("h", "sp").agg(F.min(F.struct("d", "s", "v")).alias("first")), "first")
    several = ws.save(first.groupBy("h").count().filter("count > 1").select("h"), "several")
    before = F.struct("first.d", "first.s")
    judged = found.join(first.hint("merge"), ["h", "sp"])
    copies = judged.filter(where > before).select("d", "v", "s", "h", "sp", F.lit(0).alias("kind"))
    distinct = first.select("first.d", "first.v", "first.s", "h", "sp")
    if many:  # the same span at the same place of another text with the same id
        distinct = distinct.union(judged.filter("v != 0 and v != first.v").filter(where == before).select("d", "v", "s", "h", "sp"))
    distinct = distinct.join(several.hint("merge"), "h").select("d", "v", "s", "h", "sp", F.lit(1).alias("kind"))
    marks = ws.save(copies.union(distinct).groupBy("d", "v").agg(F.collect_list(F.struct("s", "h", "sp", "kind")).alias("marks")), "marks")
    ws.drop("found", "first", "several")
    ws.release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each marked span its range (a copy) or its bytes (one of several)."""
        for big in batches:
            for batch in slices(big, "t", SLICE):
                x = ByteSpans(batch.column("t"), length)
                raw = x.data.tobytes()
                row, marks = lists(batch.column("marks"))
                order = x.text << 32 | x.place
                at = np.searchsorted(order, row << 32 | numbers(marks, "s").astype(np.int64))
                h, sp, kind = (numbers(marks, c) for c in ("h", "sp", "kind"))
                if not ((x.text[at] == row) & (x.seed[at] == h) & (x.span[at] == sp)).all():
                    raise RuntimeError("a text changed between two reads of the input")
                bulk = kind == 1
                d, v = (batch.column(c).to_numpy()[row] for c in ("d", "v"))
                body = [raw[b : b + n - 1 + length] if full else None for b, n, full in zip(x.begin[at].tolist(), x.starts[at].tolist(), bulk.tolist())]
                columns = [pa.array(h), pa.array(d), pa.array(v), pa.array(x.place[at].astype(np.int32)), pa.array(x.starts[at].astype(np.int32)), pa.array(x.inside[at].astype(np.int32)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "d", "v", "s", "n", "o", "body"])

    parts = ws.save(docs.join(marks.hint("merge"), ["d", "v"]).mapInArrow(cut, PIECE), "parts")
    ws.drop("marks")
    ws.release()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, CHUNK):
            yield from late(rows)

    def late(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        h, d, v, s, n, o = (rows.column(c).to_numpy() for c in ("h", "d", "v", "s", "n", "o"))
        bodies = rows.column("body").to_pylist()
        kept, skip, many = shared_parts(bodies, n.astype(np.int64), o.astype(np.int64), h, length)
        if not len(kept):
            return
        parts = [bodies[i][a : a + m - 1 + length] for i, a, m in zip(kept.tolist(), skip.tolist(), many.tolist())]
        piece, start = repeats(parts, many, d[kept], s[kept] + skip, length)
        if not len(piece):
            return
        start, piece = start + skip[piece], kept[piece]
        order = np.lexsort((start, piece))
        piece, start = piece[order], start[order]
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(piece)) - 1
        p = piece[a]
        yield pa.RecordBatch.from_arrays([pa.array(d[p]), pa.array(v[p]), pa.array((s[p] + start[a]).astype(np.int32)), pa.array((s[p] + start[b] + length).astype(np.int32))], names=["d", "v", "s", "e"])

    pieces, covers = uncrowd(ws, parts.filter("body is not null"), Bytes, length, ["d", "s"], CROWD)
    dealt = pieces.repartition("h").sortWithinPartitions("h")
    covers.append(ws.save(dealt.mapInArrow(sort, "d long, v long, s int, e int"), "sorted"))
    covers.append(parts.filter("body is null").select("d", "v", "s", (F.col("s") + F.col("n") - 1 + length).alias("e")))
    every = covers[0]
    for c in covers[1:]:
        every = every.union(c)
    return every.groupBy("d", "v").agg(F.collect_list(F.struct("s", "e")).alias("cover"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier (smaller id, or the same id further up).

    Overlaps count; strings are judged on the input. Returns id_col, n_bytes, n_removed, spans (array of maximal removed
    byte ranges: start, n) and rest (binary: the remaining bytes, which need not be valid UTF-8). A null text counts as
    empty; texts shorter than ``length`` stay. Rows without an id are kept whole and take nothing from others; rows that
    share an id are one document, so only a different place makes one of their strings later. Rows of one id and text
    are judged once and each give a row. Extra columns are ignored; an empty table gives an empty result. A text longer
    than SLICE is worked on in overlapping blocks.
    """
    ws = Workspace(docs.sparkSession, "suffix")
    rows, documents, many = identified(ws, docs, id_col, text_col)
    covers = _covers(ws, documents, many, length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "t", SLICE):
                data, offsets = flat_bytes(batch.column("t"))
                raw, n = data.tobytes(), batch.num_rows
                row, cover = lists(batch.column("cover"))
                depth = np.zeros(len(data) + 1, np.int32)
                if len(row):
                    np.add.at(depth, offsets[row] + numbers(cover, "s"), 1)
                    np.add.at(depth, offsets[row] + numbers(cover, "e"), -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans, rest, removed = [], [], []
                for i in range(n):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    mine = gone[a:b]
                    removed.append(int(np.count_nonzero(mine)))
                    if not removed[-1]:
                        spans.append([])
                        rest.append(raw[a:b])
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    spans.append([{"start": s, "n": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    rest.append(data[a:b][~mine].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))), pa.array(rest, pa.binary())],
                    names=["d", "n_bytes", "n_removed", "spans", "rest"],
                )

    out = rows.join(covers.hint("merge"), ["d", "v"], "left").mapInArrow(remove, "d long, n_bytes long, n_removed long, spans array<struct<start:int,n:int>>, rest binary")
    return out.withColumnRenamed("d", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    """Digest of what is left of every document."""
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))
