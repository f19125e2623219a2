"""Exact quantiles by one aggregate and by ranges give the same."""

import random

import numpy as np
import pytest

from cohortlake.operators import longform


@pytest.mark.parametrize("few", [0, 10**6])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(longform, "FEW", few)
    r = random.Random(few)
    rows = [("ab"[i % 2], r.choice([1.0, 2.0, r.random() * 9]), r.randint(1, 4)) for i in range(500)] + [("c", 3.0, 5)]
    merged = {}
    for g, v, c in rows:
        merged[g, v] = merged.get((g, v), 0) + c
    got = longform.quantiles(spark.createDataFrame([(g, v, c) for (g, v), c in merged.items()], "g string, value double, c long"), ["g"], {"a": 0.0, "b": 0.1, "m": 0.5, "z": 1.0}).collect()
    for x in got:
        own = np.repeat([v for (g, v) in merged if g == x.g], [c for (g, _), c in merged.items() if g == x.g])
        assert [x.a, x.b, x.m, x.z] == pytest.approx(list(np.quantile(own, [0, 0.1, 0.5, 1])))
    assert longform.quantiles(spark.createDataFrame([], "value double, c long"), [], {"m": 0.5}).first()[0] is None if few else True


def test_welch_takes_no_quantiles(spark, monkeypatch):
    from cohortlake.operators import association, longform

    def refused(*_):
        raise AssertionError("no test of means needs a median")

    monkeypatch.setattr(longform, "quantiles", refused)
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2]) for i in range(80)], "v double, g string")
    r = association.welch(df, "v", "g", "a", "b").first()
    assert (r.n_a, r.n_b) == (40, 40)


def test_only_values_around_a_quantile_are_put_in_order(spark, monkeypatch):
    ordered, whole = [], longform.ranged
    monkeypatch.setattr(longform, "FEW", 50)
    monkeypatch.setattr(longform, "ranged", lambda counts, by: ordered.append(counts.count()) or whole(counts, by))
    values = [i * 0.37 for i in range(5000)] + [1e9, -1e300]
    rows = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "value double, c long")
    got = longform.quantiles(rows, [], {"low": 0.25, "m": 0.5}).first()
    own = np.repeat(values, [1 + i % 3 for i in range(len(values))])
    assert tuple(got) == pytest.approx(tuple(np.quantile(own, [0.25, 0.5])))
    rows = spark.createDataFrame([(v, 1) for v in values[:5000]], "value double, c long")
    assert longform.quantiles(rows, [], {"m": 0.5}).first().m == pytest.approx(np.median(values[:5000])) and ordered[-1] <= 50
