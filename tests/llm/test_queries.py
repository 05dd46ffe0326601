"""Every query of the subpackage over whole tables of the smallest size, against its SQL where it has one."""
import os

import duckdb
import pytest

from tabulario.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(spark, key):
    con = duckdb.connect()
    for name in ("pages", "documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    cursor = con.execute(ORACLES[key])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[key](spark, FOLDER).select(*names).collect()) == want


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
