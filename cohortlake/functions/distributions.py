"""Tail probabilities of the normal, t, chi-square and F distributions, for the few values a test ends with."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_p(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_p(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_p(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_p(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float | None:
    """Exact p of a 2 x 2 table: the tables with its margins that are no likelier than it."""
    if None in (a, b, c, d) or a + b + c + d == 0:
        return None
    row, col, n = a + b, a + c, a + b + c + d
    pick = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    chance = lambda k: math.exp(pick(row, k) + pick(n - row, col - k) - pick(n, col))
    own = chance(a) * (1 + 1e-7)
    return min(1.0, sum(p for k in range(max(0, col - (n - row)), min(row, col) + 1) if (p := chance(k)) <= own))


def t_quantile(p: float, df: float) -> float:
    """The t that two-sided p leaves outside, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > p else (low, mid)
    return high


def noncentral_t_sf(t: float, df: float, shift: float) -> float:
    """P(T > t): Simpson's rule over the chi that divides the shifted normal."""
    spread = 9 / math.sqrt(2 * df)
    low, high, steps = max(1e-9, 1 - spread), 1 + spread, 400
    log_c = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    total = 0.0
    for i in range(steps + 1):
        s = low + (high - low) * i / steps
        total += (1 if i in (0, steps) else 4 if i % 2 else 2) * math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * normal_sf(t * s - shift)
    return total * (high - low) / steps / 3


def t_test_power(d: float | None, n1: float, n2: float, alpha: float = 0.05) -> float | None:
    """Power of a two-sided two-sample t test for a standardised effect d."""
    if d is None or n1 is None or n2 is None or d != d or n1 != n1 or n2 != n2 or min(n1, n2) < 2:
        return None
    df, shift = n1 + n2 - 2, abs(d) * math.sqrt(n1 * n2 / (n1 + n2))
    edge = t_quantile(alpha, df)
    return min(1.0, noncentral_t_sf(edge, df, shift) + noncentral_t_sf(edge, df, -shift))


def one_sample_power(d: float | None, n: float, alpha: float = 0.05) -> float | None:
    """Power of a two-sided one-sample or paired t test for a standardised effect d."""
    if d is None or n is None or d != d or n != n or n < 2:
        return None
    shift, edge = abs(d) * math.sqrt(n), t_quantile(alpha, n - 1)
    return min(1.0, noncentral_t_sf(edge, n - 1, shift) + noncentral_t_sf(edge, n - 1, -shift))


def t_test_size(d: float | None, wanted: float, alpha: float = 0.05, kind: str = "two-sample", most: float = 1e12) -> int | None:
    """Rows (a group, if two) that give a two-sided t test of a standardised effect d the power ``wanted``, to the nearest one; null for no
    effect, or beyond ``most``. The bracket that holds the answer shrinks by false position, halved where that is slow."""
    if d is None or d != d or d == 0:
        return None
    power = (lambda n: t_test_power(d, n, n, alpha)) if kind == "two-sample" else (lambda n: one_sample_power(d, n, alpha))
    low, high = 2.0, 4.0
    if power(low) >= wanted:
        return 2
    while power(high) < wanted:
        low, high = high, high * 2
        if low > most:
            return None
    f_low, f_high = power(low) - wanted, power(high) - wanted
    for step in range(200):
        if high - low < 1e-3:
            break
        guess = low + (high - low) * f_low / (f_low - f_high) if step % 3 and f_low != f_high else (low + high) / 2
        guess = min(max(guess, low + 1e-4 * (high - low)), high - 1e-4 * (high - low))
        f = power(guess) - wanted
        low, f_low, high, f_high = (guess, f, high, f_high) if f < 0 else (low, f_low, guess, f)
    return round((low + high) / 2)
