import math
import random

import duckdb
import pytest

from foldcast.llm import lines, mixing


def brute(rows):
    """Texts after line dedup, by the definition (rows without an id stay; equal id and text: one document)."""
    first, windows = {}, []
    for n, (d, t) in enumerate(rows):
        ls = (t or "").split("\n")
        for p in range(len(ls) - 2):
            if d is not None:
                k = tuple(ls[p : p + 3])
                windows.append((n, (d, p), k))
                first[k] = min(first.get(k, (d, p)), (d, p))
    gone = {}
    for n, at, k in windows:
        if at > first[k]:
            gone.setdefault(n, set()).update(range(at[1], at[1] + 3))
    return sorted([(d, 0 if t is None else len(t.split("\n")), len(gone.get(n, ())), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(n, ()))) for n, (d, t) in enumerate(rows)], key=str)


def corpus():
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "long line é", "c"]) for _ in range(rng.randint(0, 14)))) for i in rng.sample(range(10**6), 120)]
    return [*rows, (None, rows[5][1]), (1, None), (2, ""), (3, "x\ny\nz"), (3, "x\ny\nz"), (4, "q\n" * 5000), (5, "x\ny\nz\nx\ny\nz")]


def test_lines_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, 5, t, "en") for d, t in rows], "doc_id long, n_lines int, text string, d string").repartition(3)
    got = lines.dedup(docs)
    assert got.columns == ["doc_id", "text", "d", "n_lines", "n_removed"]
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()], key=str) == brute(rows)
    assert lines.dedup(docs.limit(0)).count() == 0


def oracle(rows, sql):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(db.execute(sql).fetchall(), key=str)


def test_line_sql(spark, tmp_path):
    rows = [(d, t, None) for d, t in {r[0]: r for r in corpus() if r[0] is not None}.values()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted([tuple(r) for r in lines.op1(spark, str(tmp_path)).collect()], key=str) == oracle(rows, lines.OP1_SQL)


def mixed_rows():
    rng = random.Random(4)
    rows = [(i, "t" * rng.randint(0, 60), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(900)]
    return [*rows, (None, "x", "a"), (3, "t", "a"), (901, None, "b"), (902, "", "empty"), (903, None, "empty")]


def test_mixing_sql(spark, tmp_path):
    rows = mixed_rows()
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted([tuple(r) for r in mixing.op4(spark, str(tmp_path)).collect()], key=str) == oracle(rows, mixing.OP4_SQL)


def test_counts_are_poisson(spark):
    docs = spark.createDataFrame([(i, "abcd", "a" if i < 3000 else "b", 7) for i in range(4000)], "doc_id long, text string, source string, copy int")
    out = mixing.mix(docs, {"a": 1.0, "b": 3.0, "absent": 0.0}, epochs=1.0)
    counts = [r["count"] for r in out.filter("source = 'b'").groupBy("doc_id").count().collect()]
    assert sum(counts) / 1000 == pytest.approx(3.0, abs=0.25)
    assert counts.count(3) / 1000 == pytest.approx(math.exp(-3) * 27 / 6, abs=0.05)
    assert out.filter("source = 'a'").count() / 3000 == pytest.approx(1 / 3, abs=0.05)
    assert out.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_lines_keep_columns_whose_names_clash(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd\ne"), (2, "a\nb\nc\nd\ne"), (3, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], "doc_id long, text string, d int, at int, k int, `row.a` string")
    got = lines.dedup(docs)
    assert got.columns == ["doc_id", "text", "d", "at", "k", "row.a", "n_lines", "n_removed"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([(1, rows[0][1], 1, 2, 3, "x", 4, 0)] + [(2, "e", 1, 2, 3, "x", 5, 4)] * 2 + [(3, None, 1, 2, 3, "x", 0, 0)], key=str)
