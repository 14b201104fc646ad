import gc
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.llm import bpe, simhash, similar, toxicity

from .test_simhash import roots


def shingles(text, k=5):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """The distinct (id, text) that stay, by the definition; rows without an id are left out."""
    known = sorted({r for r in rows if r[0] is not None}, key=str)
    sets = [shingles(t) for _, t in known]
    links = [(i, j) for i in range(len(known)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    root = roots(range(len(known)), links)
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(known[i])
    return groups.values()


def edited(words, at):
    return [("new%d" % i if i in at else w) for i, w in enumerate(words)]


def test_edited_copies_around_the_threshold(spark):
    """Of 204 words 200 shingles; c apart edits change 5c of them: similarity (200 - 5c) / (200 + 5c), 0.818 for 4 and 0.778 for 5."""
    rng = random.Random(3)
    rows, want = [], []
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        more, less = edited(words, range(10, 40, 8)), edited(words, range(100, 140, 8))
        assert jaccard(shingles(" ".join(words)), shingles(" ".join(more))) > 0.8 > jaccard(shingles(" ".join(words)), shingles(" ".join(less))) > 0.75
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(more)), (3 * g + 2, " ".join(less))]
        want += [3 * g, 3 * g + 2]
    stage = pytest.importorskip("corpus_pipeline").drop_near_copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == want


def test_exactly_at_the_threshold(spark):
    """9 shingles in one text, the first 8 of them and 1 other in the other: 8 / 10."""
    rows = [(1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l X"), (3, "p q r s t u v w x y z"), (4, "p q r s t u v w x y Y")]
    assert [jaccard(shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in (0, 2)] == [0.8, 6 / 8]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [1, 3, 4]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BUCKET", 8)
    rng = random.Random(6)
    rows = []
    for i in range(260):
        if i > 5 and rng.random() < 0.8:
            words = (rows[rng.randrange(6)][1] if rng.random() < 0.6 else rng.choice(rows)[1]).split(" ")
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(["Alpha", "beta", "é"])
        else:
            words = [f"{rng.choice('abcdefghij')}{rng.randrange(50)}" for _ in range(rng.randint(30, 200) if i < 6 else rng.randint(1, 200))]
        rows.append((rng.randrange(10**6), " ".join(words)))
    rows += [(5, None), (4, ""), (6, " \n"), (9, "one"), (10, "ONE"), (11, "one two"), (12, "w " * 30000), (None, "one"), (None, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, i string").repartition(3)
    out = similar.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    groups = brute(rows)
    assert got == sorted([min(g, key=lambda r: r[0]) for g in groups] + [(None, "one"), (None, None)], key=str)
    assert max(map(len, groups)) > 20
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_group_links_find_what_the_star_missed():
    """b and c are near to each other, not to a."""
    sets = [np.arange(100), np.arange(50, 150), np.arange(52, 152)]
    a, b = similar.group_links(np.array([7, 8, 9]), np.array([100, 100, 100]), np.concatenate(sets))
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist())} == {frozenset((1, 2))}


def test_one_row_of_repeated_ones_stays(spark):
    """An id with two texts, and rows of one id and text that differ elsewhere."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "b"), (3, text, "a"), (5, text, "a"), (3, "quite another text of its own", "z"), (7, "quite another text of its own", "z"), (9, None, "n"), (9, None, "n"), (None, text, "x"), (None, text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__row` string").repartition(3)
    out = similar.keep_one(docs)
    assert out.columns == docs.columns
    want = [(3, text, "a"), (3, "quite another text of its own", "z"), (9, None, "n"), (None, text, "x"), (None, text, "x")]
    assert sorted([tuple(r) for r in out.collect()], key=str) == sorted(want, key=str)


def prints(texts):
    h, offsets = similar.shingle_sets(pa.array(texts))
    return simhash.majority(h, offsets[:-1])


def test_majority_equals_plain_counts():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 254, 255, 256, 511, 1500, 3]
    h, starts = rng.integers(0, 1 << 64, sum(sizes), dtype=np.uint64), np.cumsum(sizes) - sizes
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[a : a + n].tolist()) > n) for a, n in zip(starts, sizes)]
    assert simhash.majority(h, starts).tolist() == want


def test_fingerprints_link_where_no_band_is_shared(spark, monkeypatch):
    """Without shared bands all links come from the fingerprints; those of unlike sets are refused."""
    rng = random.Random(8)
    rows = []
    for g in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        rows += [(3 * g + i, " ".join(edited(words, at))) for i, at in enumerate(([], [40], [900, 2000]))]
    short = [f"p q r s t{i} u v" for i in range(20000)]
    apart = np.bitwise_count(prints(short) ^ prints([f"{t} x" for t in short]))
    a = short[int(apart.argmin())]
    assert apart.min() <= similar.NEAR and jaccard(shingles(a), shingles(f"{a} x")) == 3 / 4
    rows += [(50, a), (51, f"{a} x")]
    fps = prints([t for _, t in rows])
    links = [(i, j) for i in range(30) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= similar.NEAR]
    want = sorted({*roots(range(30), links).values(), 50, 51})
    assert len(want) < 20
    whole = similar._signed
    monkeypatch.setattr(similar, "_signed", lambda texts: whole(texts).withColumn("bands", F.array(F.xxhash64("i", "x"))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = pytest.importorskip("corpus_pipeline").drop_near_copies
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == want


def test_links_keep_to_the_radius(monkeypatch):
    """Sets at 0.8 lie within RADIUS bits; a pair beyond the radius is no link."""
    rng = np.random.default_rng(7)
    for a, b, shared in ((4, 5, 4), (9, 9, 8), (90, 90, 80)):
        assert similar.near(shared, a, b)
        h = rng.integers(0, 1 << 64, (3000, a + b - shared), dtype=np.uint64)
        first, second = (simhash.majority(np.ascontiguousarray(x).ravel(), np.arange(3000) * x.shape[1]) for x in (h[:, :a], h[:, -b:]))
        assert 8 < np.bitwise_count(first ^ second).mean() < 13 and np.bitwise_count(first ^ second).max() <= similar.RADIUS
    h = rng.integers(0, 1 << 63, 20)
    args = np.array([1, 2]), np.array([19, 19]), np.concatenate([h[:19], h[1:]])
    assert [len(x) for x in similar.group_links(*args)] == [1, 1]
    monkeypatch.setattr(similar, "RADIUS", 0)
    assert simhash.majority(h[:19], np.array([0])) != simhash.majority(h[1:], np.array([0]))
    assert [len(x) for x in similar.group_links(*args)] == [0, 0]


class Plan:
    """A frame that gives the function it is asked to map."""

    def __init__(self, *fields):
        self.schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
        self.columns = list(fields)

    def drop(self, *names):
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_worker_holds_nothing_of_the_operator_before(monkeypatch):
    """The vocabulary of bpe, tables of some hundred MB in each worker, goes when a task of another stage begins; its own tasks share it."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    coders = lambda: sum(isinstance(x, bpe.Coder) for x in gc.get_objects())
    machine = toxicity.Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, toxicity.FACTORS)))
    gc.collect()
    before = coders()
    for run, columns in ((similar._sets(Plan()), {"k": [1], "t": ["a b"]}), (similar._signed(Plan()), {"i": [1], "x": [2], "t": ["a b"]}), (toxicity.score(Plan("text"), machine), {"text": ["a b"]})):
        kept = bpe.coder(path) is bpe.coder(path)
        assert kept and coders() == before + 1
        assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_pydict(columns)]))) == 1
        gc.collect()
        assert coders() == before


def test_whole_rows_are_not_sorted(spark):
    """The rows that go are looked up in a table of their keys, so neither rows nor texts fill a sort."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string").repartition(3)
    out = similar.keep_one(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
