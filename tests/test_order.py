"""Running sums over ranges, and counts of ordered pairs, against brute force."""

import random

import numpy as np
import pytest

from cohortlake.operators import inference, longitudinal
from cohortlake.operators.order import Ranges, _above, dominated


@pytest.fixture(params=[1, 6])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running(spark, parts):
    r = random.Random(3)
    rows = [(None if k % 9 == 0 else k % 2, i, r.choice([None, 1.0, 0.5, 2.0, 3.0])) for i, k in enumerate(r.choices(range(20), k=200))]
    t = Ranges(spark.createDataFrame(rows, "g int, i int, v double"), ["g"], [("i", False)])
    for reverse in (False, True):
        got = t.running(t.rows, reverse, s=("sum", "v"), p=("product", "v"), lo=("min", "v"), hi=("max", "v")).collect()
        assert len(got) == len(rows)
        for x in got:
            own = [v for g, i, v in rows if g == x.g and v is not None and (i <= x.i if reverse else i >= x.i)]
            wanted = (sum(own), float(np.prod(own)), min(own), max(own)) if own else (None,) * 4
            assert (x.s, x.p, x.lo, x.hi) == pytest.approx(wanted)


def test_above():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        a, b, rank = r.integers(0, 5, n), r.integers(0, 5, n), r.permutation(n)
        assert _above(a, b, rank) == sum(int(a[i] * b[j]) for i in range(n) for j in range(i + 1, n) if rank[i] < rank[j])


@pytest.mark.parametrize("xs,ys", [(5, 5), (1, 50), (50, 1), (300, 300), (2, 300)])
def test_dominated(spark, parts, xs, ys):
    r = random.Random(xs * ys)
    cells = {(r.randrange(xs), r.random() if ys > 100 else r.randrange(ys)): (r.randrange(4), r.randrange(4)) for _ in range(400)}
    got = dominated(spark.createDataFrame([(x, 0, float(y), *v) for (x, y), v in cells.items()], "x int, z int, y double, a int, b int"), ["x", "z"], "y", "a", "b").first().total
    assert int(got) == sum(v[0] * w[1] for (x, y), v in cells.items() for (x2, y2), w in cells.items() if x < x2 and y < y2)


def test_pairs_of_continuous_values(spark, parts):
    r = np.random.default_rng(5)
    n = 1500
    a, t = r.normal(size=n), np.ceil(r.exponential(30, n))
    b, e = a + r.normal(size=n), (r.random(n) < 0.6).astype(int)
    df = spark.createDataFrame([(float(x), float(y), float(z), int(w)) for x, y, z, w in zip(a, b, t, e)] + [(None, 1.0, 0.0, 1), (float("nan"), 1.0, -1.0, 0)], "a double, b double, t double, e int")
    tau = np.sum(np.sign(a[:, None] - a) * np.sign(b[:, None] - b)) / (n * (n - 1))
    assert inference.kendall(df, "a", "b").first()["tau"] == pytest.approx(tau, abs=1e-12)
    first = (e[:, None] == 1) & ((t[:, None] < t) | ((t[:, None] == t) & (e == 0)))
    got = longitudinal.concordance(df, "t", "e", "a").first()
    assert (got.pairs, got.concordant, got.tied) == (first.sum(), (first & (a[:, None] > a)).sum(), 0)
    rough = df.selectExpr("t", "e", "round(a) AS a")
    got, a = longitudinal.concordance(rough, "t", "e", "a").first(), np.array([float(r.a) for r in rough.limit(n).collect()])
    assert (got.pairs, got.concordant, got.tied) == (first.sum(), (first & (a[:, None] > a)).sum(), (first & (a[:, None] == a)).sum())
    assert longitudinal.concordance(df.limit(0), "t", "e", "a").first().c_index is None
