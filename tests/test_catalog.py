"""Every registered relational query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessella import catalog
from tessella.session import TABLES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    relation = duck.sql(SQL[name])
    columns = sorted(relation.columns)
    assert sorted(df.columns) == columns
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    wanted = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    assert got == sorted(map(repr, wanted))


@pytest.mark.parametrize("keys", ["CASE WHEN id % 400 > 0 THEN (id * 700001) % 1003007 END AS o_orderkey FROM range(1003007) t(id)", "id AS o_orderkey FROM range(0) t(id)"])
def test_sequence_digest_of_more_than_a_thousand_chunks(spark, tmp_path, keys):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT {keys}) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = QUERIES["d36_sequence_digest"](spark, str(tmp_path)).select("chunks", "digest").collect()
    assert [tuple(r) for r in got] == con.sql(f"SELECT chunks, digest FROM ({SQL['d36_sequence_digest']})").fetchall()


def test_uncertainty_of_certain_and_of_missing_scores(spark, tmp_path):
    """The SQL takes 0 * ln(0), which is NaN, where a probability is exactly 0 or 1; the entropy there is 0."""
    lengths = "[NULL, 0, 2000, 5000, 57000, 61746, 600000, 800000, 1119200, 5000000]"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW given AS SELECT generate_subscripts({lengths}, 1) AS doc_id, unnest({lengths})::BIGINT AS n_chars")
    con.execute(f"COPY (SELECT doc_id, 'x' AS text, 'en' AS lang, 's' AS source, n_chars FROM given) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT doc_id, 1 AS quality, 0 AS toxic FROM given) TO '{tmp_path}/labels.parquet'")
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    relation = con.sql(SQL["d40_uncertainty"])
    got = sorted(tuple(r) for r in QUERIES["d40_uncertainty"](spark, str(tmp_path)).select(*relation.columns).collect())
    wanted = sorted(tuple(0.0 if v != v else v for v in r) for r in relation.fetchall())
    assert got == wanted
    assert got[0][1:3] == (None, None) and got[5][1:3] == (0.0, 0.0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
