import random

import numpy as np
import xxhash

from foldcast.llm import simhash
from foldcast.llm.common import Workspace
from foldcast.llm.components import components


def plain_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    known = [(d, f) for d, f in fps if d is not None]
    links = [(a, b) for i, (a, f) in enumerate(known) for b, g in known[:i] if (f ^ g).bit_count() <= 3]
    root = roots({d for d, _ in known}, links)
    return sorted([(d, f"{f:016x}", root.get(d)) for d, f in fps], key=str)


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(["Alpha", "beta", "é"])
        else:
            words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 300))]
        rows.append((rng.randint(0, 10**6), " ".join(words)))
    return [*rows, (5, None), (4, ""), (6, " \n"), (9, "one"), (9, "one"), (10, "ONE"), (11, "one two"), (None, "one"), (None, None), (12, "w " * 30000)]


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted([tuple(r) for r in simhash.op9(spark, str(tmp_path)).collect()], key=str) == brute(rows)


def test_links_hold_in_chunked_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    monkeypatch.setattr(simhash, "HELD", 50)
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    ws = Workspace(spark, "test")
    got = {r.node: r.root for r in components(ws, simhash.links(ws, classes, 3)).collect()}
    want = roots(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {n: got.get(n, n) for n in want} == want
    assert len(set(want.values())) < len(fps)


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**9), 700)
    links = list(zip(ids[:400], ids[1:400])) + [(ids[500], x) for x in ids[501:]] + [(3, 3)]
    got = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots({x for l in links for x in l}, links)


def test_an_id_with_two_texts_links_their_classes(spark):
    rng = random.Random(3)
    a, z, y = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(50)) for _ in range(3))
    rows = [(5, a), (9, a), (9, z), (20, z), (30, y), (30, z), (31, y)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7 and len({r.fp for r in got}) == 3
    assert {r.component_id for r in got} == {5}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert np.array_equal(simhash.bucket_links(np.zeros(0, np.int64), np.zeros(0, np.uint64), 3)[0], [])
