import os

import duckdb
import pytest

from shiftlens.plans import motifs, overlays, registry, signals  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_against_sql(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert rows == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
