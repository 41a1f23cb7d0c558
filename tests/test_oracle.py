"""Every query with a SQL twin agrees with DuckDB on the smallest tables
(row count, column names, values rounded as the driver compares them)."""

import duckdb
import pytest

import __spark_entry__ as E
from leadlens.sources.tables import TABLES, table_path
from tools.check_oracle import rows_of

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    yield c
    c.close()


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_all_sql_twins_agree(spark, con):
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name, text in sqls.items():
        sdf = qs[name](spark, SF_SMALL)
        scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
        rel = con.sql(text)
        dcols, drows = rel.columns, rel.fetchall()
        dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if sorted(scols) != sorted(dcols) or rows_of(scols, srows) != rows_of(dcols, drows):
            bad.append(name)
        elif any(TYPES.get(t, t) != dtypes.get(c) for c, t in sdf.dtypes):
            bad.append(f"{name} (types)")
    assert not bad, bad
