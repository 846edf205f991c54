"""Every query of the reference's operators against its SQL, on the smallest of the driver's tables."""

import os

import duckdb
import pytest

from tamarack.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in zip(*[table[n].to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toArrow()
    want = db.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_formulas_of_parts_beyond_the_rows_of_a_sheet(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW one AS SELECT * FROM '{SF}/part.parquet' ORDER BY p_partkey LIMIT 12")
    con.execute(f"COPY (SELECT p_partkey + r AS p_partkey, * EXCLUDE (p_partkey, r) FROM one, (VALUES (0), (999994), (1048570), (1999994), (123456789)) t(r)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = catalogue.queries()["formula_evaluation"](spark, str(tmp_path)).toArrow()
    assert got.num_rows == 59
    assert rows(got) == rows(con.sql(catalogue.oracle_sql()["formula_evaluation"]).to_arrow_table())
