import hashlib
import random

from foldcast.llm import substring


def brute(rows, window):
    """By the definition: kept words of each row, in a dictionary by row number."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        if d is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        if d is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < d:
                    gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "ccc", "été", "漢", "x1"]) + str(rng.randint(0, 40))
    passages = [[word() for _ in range(rng.randint(30, 140))] for _ in range(6)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 90))]
        if parts and rng.random() < 0.4:
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", "  ", "\t"]).join(parts)))
    copy = rows[3][1]
    rows += [(7, copy), (8, copy), (8, copy), (8, copy + " one more"), (None, copy), (9, None), (10, ""), (11, "z " * 500), (12, "z " * 700), (13, "z " * 60)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cover int").repartition(3)
    for window in (50, 12):
        got = substring.dedup(docs, window=window).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute(rows, window)
        assert all(sum(s.n for s in r.spans) == r.n_removed for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup(docs).count() == 0


def test_query_digest(spark, tmp_path):
    rows = corpus(4)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted([tuple(r) for r in substring.op3(spark, str(tmp_path)).collect()], key=str)
    assert got == sorted([(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows, 50)], key=str)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows_of(got):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str)


def test_one_anchor_in_many_distinct_spans(spark, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", 8)
    rng = random.Random(9)
    shared = [sentence(rng, n) for n in (49, 50, 55, 120)]
    texts = [f"{sentence(rng, rng.randint(1, 60))} {shared[i % 4]} {sentence(rng, rng.randint(1, 60))}" for i in range(500)]
    texts += [f"{t} {shared[2]}" for t in texts[:100]]
    rows = list(enumerate(texts))
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert rows_of(got) == brute(rows, 50)


def test_repeated_rows_and_long_texts(spark, monkeypatch):
    """Equal rows of one id, many texts of one id, and texts of several blocks."""
    monkeypatch.setattr(substring, "SLICE", 600)
    rng = random.Random(10)
    long = [sentence(rng, 1500) for _ in range(3)]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(5, long[0])] * 1500 + [(6, long[0] + "\nx")] + [(7, f"{sentence(rng, 20)} {part(long[0], i, i + 80)} {part(long[1], 0, 70)}") for i in range(150)]
    rows += [(8, long[1]), (4, long[2]), (9, long[2] + "  " + long[2]), (None, long[0])]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert rows_of(got) == brute(rows, 50)


def test_a_shared_word_hash_is_settled_by_bytes(monkeypatch):
    """With hashes that tell no word from another the words are numbered by their bytes."""
    import numpy as np
    import pyarrow as pa

    bodies = pa.array([b"a b c d e f g", b"a b x d e f g", b"q b c d e f y"], pa.binary())
    h, d, n, o = (np.array(x, np.int64) for x in ([1, 1, 1], [1, 2, 3], [4, 4, 4], [3, 3, 3]))
    monkeypatch.setattr(substring, "SEED", 1)
    want = [x.tolist() for x in substring.extend(h, d, n, o, bodies, 4)]
    monkeypatch.setattr(substring.Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    assert [x.tolist() for x in substring.extend(h, d, n, o, bodies, 4)] == want == [[1, 2], [3, 1], [3, 2]]
