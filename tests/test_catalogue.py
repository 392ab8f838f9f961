import glob
import os

import duckdb
import pytest

from chunkloom.plans import catalogue

DATA = os.environ.get("CHUNKLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name, tmp_path):
    catalogue.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    columns = sorted(r[0] for r in duck.execute(f"DESCRIBE SELECT * FROM '{tmp_path}/out/*.parquet'").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    mine = duck.execute(f"SELECT {listed} FROM '{tmp_path}/out/*.parquet' ORDER BY ALL").fetchall()
    described = duck.execute(f"DESCRIBE {catalogue.ORACLE_SQL[name]}").fetchall()
    assert sorted(r[0] for r in described) == columns
    assert mine == duck.execute(f"SELECT {listed} FROM ({catalogue.ORACLE_SQL[name]}) ORDER BY ALL").fetchall()
