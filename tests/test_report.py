"""The static report against its SQL where Little's test of pairs rejects at random."""

import random

import duckdb
import pytest

from cohortlake.operators import models
from cohortlake.plans import studies_whole  # noqa: F401 - adds its queries
from cohortlake.plans.queries import QUERIES, SQL, rounded_as_sql
from cohortlake.plans.trials import trial


def test_report_fills_in_nothing_that_is_missing_at_random(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, draw.randrange(900), "FOP"[draw.randrange(3)], round(1000 + draw.random() * 499000, 2), f"{draw.randrange(1, 6)}-P") for i in range(3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert models.little(trial(spark, str(tmp_path)), ["albumin", "cost", "age"]).first().p < 0.05
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    wanted = con.execute(f"SELECT section, variable, measure, value FROM ({SQL['static_report']})").fetchall()
    got = [tuple(r) for r in QUERIES["static_report"](spark, str(tmp_path)).select("section", "variable", "measure", "value").collect()]
    key = lambda r: tuple(str(x) for x in r[:3])
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-4)


def test_report_fills_in_no_column_of_which_most_is_missing(spark, tmp_path):
    # albumin is missing in two of three rows, which cost less: both forms of Little's test reject
    draw = random.Random(1)
    rows = [(i, draw.randrange(900), "FOP"[draw.randrange(3)], round(1000 + draw.random() * 499000 + 30000 * (i % 3 == 0), 2), f"{draw.randrange(1, 6)}-P") for i in range(3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert all(test(trial(spark, str(tmp_path)), ["albumin", "cost", "age"]).first().p < 0.05 for test in (models.little, models.little_likelihood))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name, columns in (("static_report", "section, variable, measure, value"), ("trial_analysis", "finding, n, n_a, n_b, effect, statistic, p, sentence")):
        wanted = con.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall()
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()]
        key = lambda r: tuple(str(x) for x in r[:3])
        for a, b in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True):
            assert a == tuple(pytest.approx(x, abs=2e-4) if isinstance(x, float) else x for x in b)


def test_values_printed_as_ties_are_rounded_as_in_sql(spark):
    # medians of albumin: prices of two decimals over a thousand
    draw = random.Random(5)
    values = [(draw.randrange(10000, 5000000) * 10 + 5) / 1e5 * sign for sign in (1, -1) for _ in range(2000)] + [draw.random() * 500 for _ in range(1000)] + [None]
    got = rounded_as_sql(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, value double"), 4).collect()
    wanted = duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 4)", [values]).fetchall()
    assert [r.value for r in sorted(got, key=lambda r: r.i)] == [x for (x,) in wanted]
