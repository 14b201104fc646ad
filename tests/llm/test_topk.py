import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from foldcast.llm import topk


def vectors():
    rng = random.Random(6)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.0, 0.25]) for _ in range(7)], 3) for i in range(400)]
    rows += [(i, [0.5] * 7, 3) for i in range(400, 460)]
    bad = [(500, None, 1), (550, [None] + [0.1] * 6, 1), (501, [float("nan")] * 7, 1), (502, [float("inf")] * 7, 1), (600, [0.0] * 7, 2), (None, [1.0] * 7, 2)]
    return rows + bad


def test_equals_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "FIRST_LEVELS", 2)
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, rank int").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk.op7(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(topk.OP7_SQL).fetchall())


def test_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(-50, 50, (5000, 3)), axis=0) + rng.integers(-3, 3, (5000, 3))
    ids = np.arange(5000)
    block = topk.Block(ids, x)
    for own in range(0, 5000, 500):
        scores = x @ x[own]
        want = [i for i in np.lexsort((ids, -scores)) if i != own][:5]
        for floor in (None, int(scores[want[-1]]), int(scores[want[1]])):
            got = block.best(x[own], own, 5, floor)
            above = [i for i in want if floor is None or scores[i] >= floor]
            assert got[0].tolist() == above and got[1].tolist() == scores[above].tolist()
    assert block.scored < 30 * 5000 / 4


def test_few_rows_and_large_numbers(spark):
    docs = spark.createDataFrame([(0, [3e6, 1.0]), (50, [2e6, -1.0]), (50, [2e6, -1.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    rows = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(docs, F.col("vec_id") % 50 == 0).collect()}
    assert rows == {(0, 1): (50, 768000000 * 512000000 - 65536), (50, 1): (0, 768000000 * 512000000 - 65536)}
    assert topk.search(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0
