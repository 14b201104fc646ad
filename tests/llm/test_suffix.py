import hashlib
import random

import numpy as np
import pytest

from foldcast.llm import suffix


def brute(rows, length):
    """By the definition: (id, bytes, removed, runs, rest) of each row."""
    texts = [(t or "").encode() for _, t in rows]
    first = {}
    for (d, _), x in zip(rows, texts):
        if d is not None:
            for s in range(len(x) - length + 1):
                k = x[s : s + length]
                first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for (d, _), x in zip(rows, texts):
        gone = np.zeros(len(x), bool)
        if d is not None:
            for s in range(len(x) - length + 1):
                if first[x[s : s + length]] < (d, s):
                    gone[s : s + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
        out.append((d, len(x), int(gone.sum()), runs, bytes(np.frombuffer(x, np.uint8)[~gone])))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["and", "of", "the", "été", "漢字", "stone", "x"]) + str(rng.randint(0, 30))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]
        text = rng.choice([" ", "\n", ""]).join(parts)
        if text and rng.random() < 0.4:
            i = rng.randrange(len(text))
            text = text[:i] + "~" + text[i + 1 :]
        rows.append((rng.randint(0, 10**6), text))
    same = rows[3][1] + passages[0]
    return [*rows, (7, same), (8, same), (8, same), (None, same), (9, None), (10, ""), (11, "z" * 1500), (12, "ab" * 900), (13, "ab" * 400 + "c"), (14, passages[1] + passages[1])]


@pytest.mark.parametrize(("hot", "chunk"), [(4096, 1 << 19), (4, 1 << 19), (4096, 3000)])
def test_equals_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix, "CROWD", hot)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rows = corpus(hot)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cover int").repartition(3)
    for length in (100, 31) if hot == 4 else (100,):
        got = suffix.dedup(docs, length=length).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.rest)) for r in got), key=str) == brute(rows, length)


def test_query_digest_and_empty(spark, tmp_path):
    rows = corpus(1)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted([tuple(r) for r in suffix.op6(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted([(d, n, g, s, hashlib.sha256(x).hexdigest()) for d, n, g, s, x in brute(rows, 100)], key=str)
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranks_are_the_inverse_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(0, 60))
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix.ranks(s)[order].tolist() == list(range(len(s)))
        short = suffix.ranks(s, 5)
        for i in range(len(s)):
            for j in range(len(s)):
                assert s[i : i + 5].tolist() >= s[j : j + 5].tolist() or short[i] < short[j]


def wrapped(rng, middle, n):
    """n texts that hold ``middle`` between words of their own, so that one seed has many distinct spans."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    return [" ".join(word() for _ in range(rng.randint(3, 30))) + middle + " ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(n)]


def test_one_seed_in_many_distinct_spans(spark, monkeypatch):
    """Crowded keys are cut down to single strings; the same passage also stands with more of its surroundings in common."""
    monkeypatch.setattr(suffix, "CROWD", 8)
    rng = random.Random(9)
    texts = wrapped(rng, " the passage that stands in all of them, of about one hundred and twenty bytes, is this one and no other ", 400)
    texts += ["before " * 20 + t for t in texts[:200]] + wrapped(rng, "é" * 45 + "-" * 11, 300)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.rest)) for r in got), key=str) == brute(rows, 100)


def test_repeated_rows_and_long_texts(spark, monkeypatch):
    """Equal rows of one id, many texts of one id, and texts of several blocks."""
    monkeypatch.setattr(suffix, "SLICE", 700)
    rng = random.Random(10)
    long = wrapped(rng, " ".join(wrapped(rng, "", 40)), 3)
    rows = [(5, long[0])] * 1500 + [(6, long[0] + "x")] + [(7, t + long[1][300:900]) for t in wrapped(rng, long[0][100:400], 150)] + [(8, long[1]), (4, long[2]), (9, long[2] + long[2]), (None, long[0])]
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.rest)) for r in got), key=str) == brute(rows, 100)
