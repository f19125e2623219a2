"""Every analytical query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from cohortlake.plans import indexed, ordered, parts, predictive, resolving, sentences, studies, studies_whole, texts, trials  # noqa: F401 - add their queries
from cohortlake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(x, str) or x is None for x in (*a, *b)) else all(x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y) for x, y in zip(a, b)), (a, b)
