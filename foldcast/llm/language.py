"""Language ID of mixed texts: script ranges narrow the candidates, Viterbi over words with a switching penalty labels spans.

Each word gets for each language the sum of the log-probabilities of its lower-cased byte n-grams (1 to 3 bytes, with
word edges), learned from at most TEXTS texts of each of the LANGUAGES most frequent labels. A word of a script in which a language was hardly ever seen
rules that language out for the word, unless no language is left. The best path through the words of a text pays
PENALTY for each change of language; its runs are the spans. The text's language is the one with most letters in spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import point_kinds
from .common import Workspace, flat_bytes, held_out, read, slices

TEXTS, LANGUAGES, GRAMS, SIZES, PENALTY, SMOOTHING, SLICE = 2000, 256, 1 << 16, (1, 2, 3), 8.0, 0.5, 4 << 20
#: A script is a candidate's if it had at least this share of the language's letters in training.
LEAST_SHARE, OUT = 0.005, -40.0
#: First code points of script ranges (Unicode blocks) and the script that starts there; 0 is common.
SCRIPTS = ("common", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "thai", "georgian", "hangul", "kana", "han", "other")
RANGES = ((0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0x300, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 13), (0x900, 7), (0x980, 13), (0xE00, 8), (0xE80, 13), (0x10A0, 9), (0x1100, 10), (0x1200, 13), (0x1C80, 3), (0x1C90, 9), (0x1CC0, 13), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 13), (0x2DE0, 3), (0x2E00, 0), (0x3040, 11), (0x3100, 12), (0x3130, 10), (0x3190, 12), (0xA640, 3), (0xA6A0, 13), (0xAC00, 10), (0xD800, 0), (0xF900, 12), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 11), (0xFFA0, 10), (0xFFE0, 0), (0x10000, 13), (0x20000, 12), (0x32000, 13))
_EDGE = np.uint32(0x100)


class _Text:
    """Words (runs of letters) of a batch: per word its row, its letters, its script, and per byte the gram numbers."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat_bytes(texts)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        place = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=place[1:])
        edges = np.searchsorted(place, offsets)
        letter = point_kinds()[points] == 1
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        before[edges[:-1][edges[:-1] < n]] = False
        after[edges[1:][edges[1:] > 0] - 1] = False
        first, last = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after)
        self.letters = last + 1 - first
        self.row = np.searchsorted(edges, first, side="right") - 1
        script = np.searchsorted([r[0] for r in RANGES], points[first + self.letters // 2], side="right") - 1
        self.script = np.array([r[1] for r in RANGES])[script]
        self.start, self.end, self.rows = place[first], place[last + 1], len(offsets) - 1
        # Bytes of words only, each word between two edge marks.
        sizes = self.end - self.start
        ends = np.cumsum(sizes + 2)
        self.at = ends - sizes - 2
        lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        self.bytes = np.full(int(ends[-1]) if len(ends) else 0, _EDGE, np.uint32)
        inner = np.ones(len(self.bytes), bool)
        inner[self.at], inner[ends - 1] = False, False
        word_byte = np.zeros(len(data) + 1, np.int8)
        word_byte[self.start] += 1
        np.subtract.at(word_byte, self.end, 1)
        self.bytes[inner] = lower[np.cumsum(word_byte[:-1]) > 0]
        self.counts = np.ones(len(self.bytes), bool)
        self.counts[self.at] = False

    def grams(self, size: int) -> np.ndarray:
        """For each marked byte the number of the gram of ``size`` bytes that ends there; those that end at a word's first mark reach into the word before and don't count."""
        h = np.zeros(len(self.bytes), np.uint32)
        for k in range(size):
            part = self.bytes if k == 0 else np.concatenate([np.full(k, _EDGE, np.uint32), self.bytes[:-k]])
            h = h * np.uint32(0x01000193) + part[: len(h)] + np.uint32(size)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        return (h >> np.uint32(16)) & np.uint32(GRAMS - 1)


@dataclass
class Model:
    """languages, log-probabilities (languages x GRAMS) and whether a script is a language's (languages x scripts)."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def words(self, text: _Text) -> np.ndarray:
        """Scores (words x languages)."""
        out = np.zeros((len(text.at), len(self.languages)))
        if not len(text.at):
            return out
        grams = [text.grams(size) for size in SIZES]
        for k in range(len(self.languages)):
            each = np.zeros(len(text.bytes), np.float32)
            for g in grams:
                each += self.table[k][g]
            each[text.at] = 0
            out[:, k] = np.add.reduceat(each, text.at)
        fits = self.allowed[:, text.script].T
        fits |= ~fits.any(1)[:, None]
        out[~fits] += OUT * np.repeat(text.letters, (~fits).sum(1))
        return out

    def path(self, text: _Text) -> np.ndarray:
        """The language number of each word on the best path of its text."""
        scores = self.words(text)
        count = np.bincount(text.row, minlength=text.rows)
        order = np.argsort(-count, kind="stable")
        first, sizes = (np.cumsum(count) - count)[order], count[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        best = np.zeros((len(order), len(self.languages)))
        source, stays = np.zeros(len(scores), np.int16), np.ones((len(scores), len(self.languages)), bool)
        for t in range(longest):
            k = active[t]
            at, v = first[:k] + t, best[:k]
            if t:
                top = v.argmax(1)
                switch = v[np.arange(k), top] - PENALTY
                stay = v >= switch[:, None]
                source[at], stays[at] = top, stay
                v = np.where(stay, v, switch[:, None])
            best[:k] = v + scores[at]
        out = np.zeros(len(scores), np.int16)
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            at, s = first[:k] + t, state[:k]
            out[at] = s
            state[:k] = np.where(stays[at, s], s, source[at])
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the texts of rows that are not held out and have a language; about TEXTS a language, chosen by a hash of the id.

    Only the LANGUAGES most frequent labels are learned (ties go to the first by name), so junk labels don't make the model
    grow. Counts of grams are summed on the executors; the model has GRAMS numbers a language, whatever the input.
    Without any such row the model has no language and every prediction is ``und``.
    """
    ws = Workspace(docs.sparkSession, "language")
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t is not null and l is not null").filter(~held_out("d"))
    sizes = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    languages = sorted(r.l for r in sizes)
    share = docs.sparkSession.createDataFrame([(r.l, TEXTS / r["count"]) for r in sizes], "l string, share double")
    picked = rows.join(F.broadcast(share), "l").filter(F.pmod(F.xxhash64("d", F.lit("language")), F.lit(1 << 30)) / (1 << 30) < F.col("share")).select("d", "t", "l")
    number = {l: i for i, l in enumerate(languages)}
    scripts = len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 2 << 20):
                text = _Text(batch.column("t"))
                lang = np.array([number[x] for x in batch.column("l").to_pylist()])
                word = lang[text.row]
                keys = [word * (GRAMS + scripts) + GRAMS + text.script]
                weights = [text.letters]
                owner = np.repeat(word, text.end - text.start + 2)[text.counts]
                for size in SIZES:
                    keys.append(owner * (GRAMS + scripts) + text.grams(size)[text.counts])
                    weights.append(np.ones(len(owner), np.int64))
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.bincount(at, np.concatenate(weights), len(key)).astype(np.int64))], names=["k", "n"])

    table = np.full((len(languages), GRAMS + scripts), 0.0)
    if languages:
        counted = picked.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        key = counted.column("k").to_numpy()
        table[key // (GRAMS + scripts), key % (GRAMS + scripts)] = counted.column("n").to_numpy()
    letters = table[:, GRAMS:]
    allowed = letters > LEAST_SHARE * np.maximum(1, letters.sum(1))[:, None]
    allowed[:, 0] = True
    grams = table[:, :GRAMS] + SMOOTHING
    ws.close()
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """id_col, lang_pred, score and, if asked for, spans (array of lang, first word, words); one pass, no shuffle.

    score is the share of the text's letters in spans of lang_pred. A null text, one without letters, and every text if
    the model has no language, gets ``und`` with score 0. A null id stays null; repeated rows each give a row; other
    columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                text, k = _Text(batch.column("t")), len(model.languages)
                n = batch.num_rows
                path = model.path(text) if k else np.zeros(0, np.int16)
                row, letters = (text.row, text.letters) if k else (np.zeros(0, int), np.zeros(0, int))
                share = np.bincount(row * max(1, k) + path, letters, n * max(1, k)).reshape(n, -1)
                total = share.sum(1)
                best = np.where(total > 0, share.argmax(1), k)
                columns = [batch.column("i"), pa.array(names[best].tolist(), pa.string()), pa.array(share.max(1) / np.maximum(total, 1))]
                if spans:
                    new = np.ones(len(path), bool)
                    new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                    at = np.flatnonzero(new)
                    count = np.diff(np.append(at, len(path)))
                    first = np.searchsorted(row, np.arange(n))
                    parts = pa.StructArray.from_arrays([pa.array(names[path[at]].tolist(), pa.string()), pa.array((at - first[row[at]]).astype(np.int32)), pa.array(count.astype(np.int32))], ["lang", "first", "words"])
                    columns.append(pa.ListArray.from_arrays(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32), parts))
                yield pa.RecordBatch.from_arrays(columns, names=["i", "lang_pred", "score", "spans"][: len(columns)])

    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, lang_pred string, score double" + ", spans array<struct<lang:string,first:int,words:int>>" * spans)
    return out.withColumnRenamed("i", id_col)


def op10(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
