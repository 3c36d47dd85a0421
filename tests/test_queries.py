"""Every query that has SQL gives the SQL's rows; the others run."""

import duckdb
import pandas as pd
import pytest

from leafwork.plans import function_queries, page_queries, service_queries  # noqa: F401  they add to the queries
from leafwork.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if pd.isna(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, oracle, name):
    got, want = QUERIES[name](spark, sf).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_line_letters_reads_whole_lines(spark, tmp_path):
    lines = ["A" * 60 + " and lower case behind", "B" * 90, "1" * 60 + " LOUD", "quiet"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["li"]: r["shout"] for r in QUERIES["line_letters"](spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False}
