import pytest

from foldcast.llm import mixing


@pytest.mark.parametrize("rare, weight", [(40, 0.5), (4, 0.9)])
def test_a_rare_source_reaches_its_share(spark, rare, weight):
    """Rates of about 50 and 900, over 16 both, and over one part the second."""
    docs = spark.createDataFrame([(i, "abcd", "rare" if i < rare else "a") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"rare": weight, "a": 1 - weight})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["rare"] / sum(n.values()) == pytest.approx(weight, abs=0.03)
    assert out.select("doc_id", "copy").distinct().count() == sum(n.values())
    held = {r.source: r.rate for r in mixing.rates(docs, {"rare": weight, "a": 1 - weight}, most_epochs=16.0).collect()}
    assert held["rare"] == 16.0


def test_op4_repeats_a_rare_source_as_often_as_its_share_needs(spark, tmp_path):
    """The square-root mix gives the rare source a rate of about 600, over one part; Spark and the SQL agree."""
    import duckdb

    rows = [(i, "t" * 4000, "big") for i in range(100)] + [(i, "x", "rare") for i in range(200, 201)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in mixing.op4(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(mixing.OP4_SQL).fetchall())
    assert 500 < sum(r[1] == "rare" for r in got) < 760
