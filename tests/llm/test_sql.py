import duckdb
import pytest

from stationspark.llm import registry


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_warc_round_trip", "op13_conversation_repair"])
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = con.sql(registry.oracle_sql()[name])
    columns, rows = expected.columns, expected.fetchall()
    got = registry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, rows)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
