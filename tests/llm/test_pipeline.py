import hashlib
import math
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from .test_lines_mixing import brute as brute_lines
from .test_similar import brute as groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 8)))
    shared = ["\n".join(" ".join(word() for _ in range(6)) for _ in range(3)) for _ in range(3)]
    rows, labels = [], []
    for i in range(500):
        if rows and rng.random() < 0.1:
            rows.append((i, rng.choice(rows)[1], "en", rng.choice("abc")))
            continue
        bad = rng.random() < 0.3
        text = "\n".join([" ".join(word() for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 8))] + [shared[i % 3]] * (rng.random() < 0.3))
        rows.append((i, text + " vermin and filth" * bad, "en", rng.choice(["a"] * 6 + ["b", None])))
        labels.append((i, 1, int(bad)))
    rows += [(600, None, None, "a"), (601, "", "en", "b"), (602, "one\ntwo", "en", None)]
    return [(*r, len(r[1] or "")) for r in rows], labels


def poisson(u, rate):
    p = c = math.exp(-rate)
    n = 0
    while c < u:
        n += 1
        p = p * rate / n
        c += p
    return n


def brute_mix(rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(r[1] or "")
    total, goal = sum(size.values()), sum(v**0.5 for v in size.values())
    out = []
    for r in rows:
        rate = size[r[3]] ** 0.5 / goal * total / size[r[3]] if size[r[3]] else 1.0
        u = (int(hashlib.md5(f"mix-1|{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        out += [r] * poisson(u, rate)
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = tables()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, frames = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames.append([tuple(r) for r in docs.collect()])
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, lines, near, mixed, coded = frames
    assert {r[0] for r in rows} - {r[0] for r in clean} == {r[0] for r in rows if "vermin" in (r[1] or "")}
    assert sorted([(r[0], r[1]) for r in lines]) == sorted([(d, t) for d, _, _, t in brute_lines([r[:2] for r in clean])])
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lines)
    kept = {min(g, key=lambda r: r[0])[0] for g in groups([r[:2] for r in lines])}
    assert sorted(near, key=str) == sorted([r for r in lines if r[0] in kept], key=str)
    assert sorted(mixed, key=str) == sorted(brute_mix(near), key=str)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), ids, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(coded, key=str) == sorted(want, key=str)
    assert sorted([tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()], key=str) == sorted(want, key=str)


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    more = ", d long, k string, at int, __i int, copy int, score string, __row int"
    docs = spark.createDataFrame([(i, t, "en", "s", 3, 7, "k", 2, 5, 6, "0.5", 9) for i, t in ((1, "a b c d"), (2, "a b c d"), (3, None), (None, "x"))], COLUMNS + more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rest = {tuple(r)[5:] for r in out.collect()}
        assert rest == {(7, "k", 2, 5, 6, "0.5", 9)}, name
