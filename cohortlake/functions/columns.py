"""Tail probabilities as columns, in Arrow batches; null where an argument is null or there are no degrees of freedom."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions import distributions as dist


def _each(f, *columns: pd.Series) -> pd.Series:
    """``f`` over rows of numbers; equal rows are computed once."""
    table = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], 1)
    rows, back = np.unique(table, axis=0, return_inverse=True)
    found = [np.nan if np.isnan(r).any() else f(*r) for r in rows.tolist()]
    return pd.Series(np.array([np.nan if x is None else x for x in found], float)[back.ravel()] if len(rows) else np.zeros(0)).astype("Float64")


@F.pandas_udf(T.DoubleType())
def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda t, df: dist.t_two_sided(t, df) if df > 0 else None, t, df)


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda x, df: dist.chi2_sf(x, df) if df > 0 else None, x, df)


@F.pandas_udf(T.DoubleType())
def _f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(lambda f, a, b: dist.f_sf(f, a, b) if a > 0 and b > 0 else None, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return _each(lambda z: 2 * dist.normal_sf(abs(z)), z)


@F.pandas_udf(T.DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(lambda a, b, c, d: dist.fisher_two_sided(int(a), int(b), int(c), int(d)), a, b, c, d)


def _double(x) -> F.Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _called(f, *columns) -> F.Column:
    return F.nanvl(f(*map(_double, columns)), F.lit(None).cast("double"))


def two_sided_t(t, df) -> F.Column:
    return _called(_t, t, df)


def chi_square_sf(x, df) -> F.Column:
    return _called(_chi2, x, df)


def f_sf(f, d1, d2) -> F.Column:
    return _called(_f, f, d1, d2)


def two_sided_normal(z) -> F.Column:
    return _called(_normal, z)


def fisher_p(a, b, c, d) -> F.Column:
    return _called(_fisher, a, b, c, d)
