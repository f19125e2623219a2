"""Tail probabilities in DuckDB's SQL by Simpson's rule, so that oracles need none of this library's functions."""

from __future__ import annotations


def _tail(density: str, x: str, scale: str = "1.0", steps: int = 2000) -> str:
    """The integral of ``density`` (of z) from x on: z = x + scale * s / (1 - s) for s from 0 to 1."""
    s = f"(k / {steps}.0)"
    z = f"({x} + {scale} * {s} / (1 - {s}))"
    weight = "(CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"({scale} * list_sum([{weight} * ({density.replace('{z}', z)}) / ((1 - {s}) * (1 - {s})) for k in range(0, {steps})]) / {3 * steps})"


def t_p(t: str, df: str) -> str:
    """Two-sided p of a t."""
    return f"(2 * {_tail(f'exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2.0 * ln(1 + {{z}} * {{z}} / {df}))', f'abs({t})')})"


def chi2_p(x: str, df: str) -> str:
    return _tail(f"exp(({df} / 2.0 - 1) * ln({{z}}) - {{z}} / 2 - {df} / 2.0 * ln(2) - lgamma({df} / 2.0))", f"greatest({x}, 1e-9)", f"greatest(1.0, {df})")


def f_p(f: str, a: str, b: str) -> str:
    return _tail(f"exp(lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0) + {a} / 2.0 * ln({a} / CAST({b} AS DOUBLE)) + ({a} / 2.0 - 1) * ln({{z}}) - ({a} + {b}) / 2.0 * ln(1 + {a} * {{z}} / CAST({b} AS DOUBLE)))", f"greatest({f}, 1e-9)")


def z_p(z: str) -> str:
    """Two-sided p of a standard normal."""
    return f"(2 * {_tail('exp(-{z} * {z} / 2) / sqrt(2 * pi())', f'abs({z})')})"
