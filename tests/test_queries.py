"""Each registered query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from lakmoes import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    got = Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in core.SQL:
        return
    r = duck.execute(core.SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(norm(row[cols.index(c)]) for c in sorted(cols)) for row in r.fetchall())
    assert got == want


def test_findings_per_source_are_whole(spark, tmp_path):
    bsn, mail = "BSN 111222333", "mail a.b@voorbeeld.nl"
    rows = [
        (1, "a", None, [(0, "p1", mail), (1, "p2", bsn)], None),
        (2, "a", "", [(0, "p1", mail)], {"auteur": "c.d@voorbeeld.nl"}),
        (3, "a", f"{mail} en {mail}", None, {"_verborgen_tabbladen": "Blad2"}),
        (4, "a", None, None, None),
        (5, None, f"{bsn}\n06-12345678", [], None),
        (6, "b", "niets", None, None),
    ]
    schema = "rij_id long, bron string, text string, chunks array<struct<idx:int,loc:string,text:string>>, meta map<string,string>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/bron_document.parquet")
    got = {r["bron"]: (r["n_url"], r["n_tekst"], r["n_hit"]) for r in core.QUERIES["per_source_findings"](spark, str(tmp_path)).collect()}
    assert got == {"a": (1, 3, 2 + 2 + 3), None: (0, 1, 2), "b": (0, 1, 0)}


def test_entry(spark):
    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())
