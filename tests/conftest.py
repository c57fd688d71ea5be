"""One session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    s = session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.fixture
def same_rows(duck, tmp_path):
    """Holds a DataFrame against SQL: names, types and rows, in any order."""

    def check(df, sql: str) -> int:
        df.write.parquet(f"{tmp_path}/got")
        duck.sql(f"CREATE OR REPLACE TEMP TABLE wanted AS {sql}")
        duck.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
        types = [dict(duck.sql(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall()) for t in ("wanted", "got")]
        assert types[0] == types[1]
        cols = ", ".join(f'"{c}"' for c in types[0])
        for a, b in (("wanted", "got"), ("got", "wanted")):
            odd = duck.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 5").fetchall()
            assert not odd, f"only in {a}: {odd}"
        return duck.sql("SELECT count(*) FROM got").fetchall()[0][0]

    return check
