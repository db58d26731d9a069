"""Every registered query against its SQL, row for row."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(str(x) for x in r)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_files_of_a_scale_are_hashed(spark):
    import hashlib

    got = {r.raw_rel_path: r.sha256 for r in entry.queries()["binary_file_hash"](spark, SF).collect()}
    assert got == {n: hashlib.sha256(open(f"{SF}/{n}", "rb").read()).hexdigest() for n in os.listdir(SF)}
