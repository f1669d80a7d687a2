"""Every registered query of the contract engine returns what its SQL does."""

import duckdb
import pytest

from clausewright.operators import ai
from clausewright.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def table(df):
    names = sorted(df.columns)
    return sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    mine = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = oracle.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(mine.columns) == sorted(want.columns) and table(mine) == table(want)


@pytest.mark.parametrize(
    "rows",
    [
        "(1, [1.0, 0.0], 1), (2, [-1.0, 0.5], 7)",
        "(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0], 7)",
        "(1, [1.0, 2.0], 1), (2, [1.0, 2.0, 9.0, 4.0], 7), (3, [5.0], 8)",
        "(1, [1.0, 2.0], 1), (2, [1.0, 3.0], 2)",
        "(1, [1.0, 2.0], 7)",
        "(1, NULL, 1), (2, [1.0], NULL)",
        "(1, [1.0, 'nan'::FLOAT], 1), (2, [1.0, 5.0], 7)",
    ],
)
def test_embedding_drift_of_odd_vectors(spark, tmp_path, rows):
    """Beyond 1, of unequal lengths, with a side empty or not a number."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE embeddings AS SELECT i::BIGINT AS vec_id, e::FLOAT[] AS embedding, l::INTEGER AS label FROM (VALUES {rows}) t(i, e, l)")
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    mine = [tuple(r) for r in catalogue.QUERIES["embedding_drift"](spark, str(tmp_path)).collect()]
    assert str(mine) == str(con.sql(catalogue.ORACLE_SQL["embedding_drift"]).fetchall())


def test_drift_status_holds_the_score_to_one(spark):
    a, b = (spark.createDataFrame([(0, v)], "pos int, value double") for v in (1.0, -1.0))
    assert ai.cosine_distance(a, b).first().drift_score == 2.0
    for other in (b, b.where("false")):
        assert ai.embedding_drift(a, other, 5).select("status", "drift_score").first() == ("FAIL", 1.0)


def test_entry_without_training_operators(spark, monkeypatch):
    import sys

    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    monkeypatch.setattr(__spark_entry__, "_llm", None)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE_SQL)
    assert "clausewright.operators.checks" in sys.modules
