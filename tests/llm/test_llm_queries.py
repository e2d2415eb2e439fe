"""Each query of the subpackage on the smallest tables, against its SQL where it has one."""

import os
from collections import Counter

import duckdb
import pytest

from lakmoes.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    df = llm.QUERIES[name](spark, SF)
    got = Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert got or name == "p7_proximity"
    if name in llm.SQL:
        c = duckdb.connect()
        for t in os.listdir(SF):
            c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
        r = c.execute(llm.SQL[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == Counter(tuple(row[cols.index(x)] for x in sorted(cols)) for row in r.fetchall())
