"""BPE encoding and decoding: a per-prefix dynamic program over byte strings.

For a piece of text let last[i] be the last token of the encoding of its first i bytes. That token is unique: of all
vocabulary entries that end at byte i (an Aho-Corasick suffix automaton reports them) it is the one that starts the
piece, or that is compatible with last[] at the place where it starts. Two tokens are compatible if merging their
concatenation leaves both whole. Following the back-pointers from the end gives exactly the ids of greedy rank-order
merging, in linear time however long the piece is.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, flat_bytes, read, slices, worker
from .textkernel import BASES, BYTE_VALUE, Rolling

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker keeps the ids of at most so many pieces, each of at most so many bytes.
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 500_000, 48, 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


_KINDS: list[np.ndarray] = []


def point_kinds() -> np.ndarray:
    """For each code point 0 for white space, 1 for a letter, 2 for a number, 3 for the rest; by the classes of the pattern."""
    if not _KINDS:
        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "?" for i in range(0x110000))
        kinds = np.full(0x110000, 3, np.uint8)
        for k, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                kinds[m.start() : m.end()] = k
        _KINDS.append(kinds)
    return _KINDS[0]


def _check(spec: dict) -> None:
    """Raise if a vocabulary file asks for what this coder doesn't do, as its ids would differ without a word."""
    model, before, after = (spec.get(k) or {} for k in ("model", "pre_tokenizer", "decoder"))
    odd = {
        "model": model.get("type", "BPE") != "BPE",
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
        "decoder": after.get("type") != "ByteLevel",
        "dropout": model.get("dropout"),
        "continuing_subword_prefix": model.get("continuing_subword_prefix"),
        "end_of_word_suffix": model.get("end_of_word_suffix"),
        "byte_fallback": model.get("byte_fallback"),
        "ignore_merges": model.get("ignore_merges"),
        "added_tokens": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if found := [k for k, v in odd.items() if v]:
        raise ValueError(f"the vocabulary file has settings that are not supported: {', '.join(found)}")


class _Pieces(dict):
    """piece -> its ids as packed int32; computed when missing, emptied when full."""

    def __init__(self, coder: "Coder"):
        self.coder = coder

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.coder.piece(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    """Encodes and decodes with one byte-level vocabulary file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [tuple(bytes(letters[c] for c in side) for side in m) for m in pairs]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        n = max([*vocab.values(), *self.special.values()]) + 1
        content = [b""] * n
        for token, i in vocab.items():
            content[i] = token
        for token, i in self.special.items():
            content[i] = token.encode()
        self.lengths = np.array([len(x) for x in content], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(content), np.uint8)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.parts:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.pieces = _Pieces(self)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that touch one edge of a token while it is being built, each with the rank of the merge that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            known, until, at = [], 1 << 60, token
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Does merging left + right leave both whole? A crossing merge of equal rank goes first only if it is further left."""
        rank, spine = self.rank.get, self._spine(right, 0)
        for a, a_until in self._spine(left, 1):
            for b, b_until in spine:
                r = rank((a, b))
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def piece(self, piece: bytes) -> bytes:
        n = len(piece)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        known, pairs = self.pairs.get, self.pairs
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length
                if start:
                    key = last[start] << 32 | token
                    fits = known(key)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last[start], token)
                    if not fits:
                        continue
                last[end], back[end] = token, start
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no token ends at byte {at} of {piece[:80]!r}")
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return array("i", ids).tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch one after another, and n + 1 offsets; each distinct piece is looked up once.

        Texts with an apostrophe (contractions) or an added token, and any text that its ids don't decode to (two pieces
        of one hash), take the plain route of ``encode``.
        """
        data, offsets = flat_bytes(texts)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        places = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64), out=places[1:])
        edges = np.searchsorted(places, offsets)
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        kinds = point_kinds()[points]
        new = edge[:n].copy()
        new[1:] |= kinds[1:] != kinds[:-1]
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], n) if n else begins
        white = kinds[begins] == 0
        first = np.zeros(n, bool)
        solid = begins[~white]
        led = (points[solid - 1] == 32) & ~edge[solid] if n else solid
        first[solid - led] = True
        first[begins[white]] = True
        first[ends[white & (ends - begins > 1) & ~edge[ends]] - 1] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], n) if n else starts
        starts_b, stops_b = places[starts], places[stops]
        hashes = Rolling(BYTE_VALUE[data], BASES[0]).of(starts_b, stops_b)
        _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        text, get = raw, self.pieces.__getitem__
        found = [get(text[a:b]) for a, b in zip(starts_b[at].tolist(), stops_b[at].tolist())]
        sizes = np.array([len(x) for x in found], np.int64) >> 2
        flat, ids_of = np.frombuffer(b"".join(found), np.int32), np.concatenate([[0], np.cumsum(sizes)])
        each = sizes[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(upto[-1]) + np.repeat(ids_of[which] - upto[:-1], each)]
        cuts = upto[np.searchsorted(starts, edges)]
        odd = set((np.searchsorted(edges, np.flatnonzero(points == 39), side="right") - 1).tolist())
        for special in self.special:
            mark, x = special.encode(), -1
            while (x := raw.find(mark, x + 1)) >= 0:
                odd.add(int(np.searchsorted(offsets, x, side="right")) - 1)
        decoded = self.decode_flat(ids)
        if len(decoded) != len(data) or not np.array_equal(decoded, data):
            odd.update(i for i in range(len(offsets) - 1) if self.decode(ids[cuts[i] : cuts[i + 1]]) != raw[offsets[i] : offsets[i + 1]])
        if odd:
            parts = [self.encode(raw[offsets[i] : offsets[i + 1]].decode()) if i in odd else ids[cuts[i] : cuts[i + 1]] for i in range(len(offsets) - 1)]
            ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, cuts

    def encode(self, text: str) -> np.ndarray:
        if self.splitter is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(self.pieces[x.encode()] for x in self.find(text)), np.int32)
        out = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            elif part:
                out.extend(self.pieces[x.encode()] for x in self.find(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.places[ids] - (ends - sizes), sizes)]

    def decode(self, ids: np.ndarray) -> bytes:
        out = self.decode_flat(ids).tobytes()
        return out if _valid(out) else out.decode("utf-8", "replace").encode()


def _valid(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


def coder(path: str) -> Coder:
    """One coder for each worker process and file, until a task of another operator comes."""
    coders = KEPT.setdefault("bpe", {})
    if path not in coders:
        coders[path] = Coder(path)
    return coders[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Encode every whole text: id_col, ids array<int>, and with ``decoded`` also the text that the ids decode to.

    ``tokenizer`` is the path of a vocabulary file that every executor has. A null text counts as empty: no ids, empty
    decoded text. A null id stays null; repeated rows each give a row; other columns of ``docs`` are not looked at.
    Added tokens that occur in a text are one id each, as in the library. There is no shuffle: each Arrow batch is
    encoded where it is read, so a lost executor costs only its own tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                ids, cuts = c.encode_batch(batch.column("t"))
                columns = [batch.column("i"), pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids))]
                if decoded:
                    columns.append(pa.array([c.decode(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["i", "ids", "decoded"][: len(columns)])

    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(worker("bpe", run), f"i {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("i", id_col)


def op8(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    out = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
