"""Scalar column expressions: rates, intervals, costs and hashed uniforms.

Three policies for an undefined rate are kept apart by name: ``rate_zero`` gives 0, ``rate_null`` gives null and
``rate_nan`` gives NaN.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
HEX_DIGITS = 12


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key's text alone (48 bits of its SHA-1)."""
    joined = F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(k) for k in key])
    return F.conv(F.substring(F.sha1(joined.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)


def nonzero(n: Column) -> Column:
    """A divisor: null instead of 0."""
    return F.when(n != 0, n)


def rate_null(k: Column, n: Column) -> Column:
    return k / nonzero(n)


def rate_zero(k: Column, n: Column) -> Column:
    return F.coalesce(rate_null(k, n), F.lit(0.0))


def rate_nan(k: Column, n: Column) -> Column:
    return F.coalesce(rate_null(k, n), F.lit(float("nan")))


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """F-beta; 0 where both are 0."""
    b = beta * beta
    return F.coalesce((1 + b) * precision * recall / nonzero(b * precision + recall), F.lit(0.0))


def f1_counts(tp: Column, fp: Column, fn: Column) -> Column:
    return rate_zero(2.0 * tp, 2.0 * tp + fp + fn)


def wilson(k: Column, n: Column, z: float = Z, clip: bool = True, empty: tuple[float, float] | None = (0.0, 1.0)) -> tuple[Column, Column]:
    """Score interval of k out of n. ``empty`` is the interval for n = 0 (None: null)."""
    n = nonzero(n)
    p = k / n
    d = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d
    low, high = middle - half, middle + half
    if clip:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    fill = (None, None) if empty is None else empty
    return tuple(F.when(n.isNotNull(), x).otherwise(F.lit(e)) for x, e in zip((low, high), fill, strict=True))


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Cohen's kappa of a two-by-two table; null where chance agreement is 1."""
    n = tp + fp + fn + tn
    observed = rate_null(tp + tn, n)
    chance = rate_null((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return (observed - chance) / nonzero(1 - chance)


def f1_interval(tp: Column, fp: Column, fn: Column, z: float = Z) -> tuple[Column, Column]:
    """Delta-method interval of F1 over the cells of the table."""
    s = 2.0 * tp + fp + fn
    f1 = 2.0 * tp / F.when(s != 0, s)
    variance = 4 * tp * (fp + fn) * (tp + fp + fn) / F.pow(nonzero(s), 4)
    half = z * F.sqrt(variance)
    return F.greatest(F.lit(0.0), f1 - half), F.least(F.lit(1.0), f1 + half)


def counts_of(n: Column, n_pos: Column, precision: Column, recall: Column) -> dict[str, Column]:
    """Cells rebuilt from rounded rates."""
    tp = F.round(recall * n_pos)
    fp = F.when(precision > 0, F.round(tp / precision - tp)).otherwise(0.0)
    return {"tp": tp, "fp": fp, "fn": n_pos - tp, "tn": n - n_pos - fp}


def symmetric_accuracy(a: Column, b: Column) -> Column:
    """The smaller of two estimates as a percentage of the larger."""
    return 100 * F.least(a, b) / F.when(F.greatest(a, b) != 0, F.greatest(a, b))


def approx_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def clip01(p: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p, F.lit(default))))


def call_cost(tokens_in: Column, tokens_out: Column, cached: Column, price_in: Column, price_out: Column, tier: Column | None = None, cached_rate: float = 0.1, tier_rate: float = 0.5) -> Column:
    """Money for one call: cached input at a share of the price, and cheaper tiers (batch, flex) at a share of the whole."""
    full = ((tokens_in - cached) * price_in + cached * price_in * cached_rate + tokens_out * price_out) / 1e6
    return full if tier is None else full * F.when(tier.isin("batch", "flex"), tier_rate).otherwise(1.0)


def split_evenly(value: Column, n: Column, whole: bool = False) -> Column:
    """One question's part of what a shared call used; tokens are split to whole numbers."""
    return F.floor(value / n).cast("long") if whole else value / n


def gpu_cost(latency_ms: Column, dollars_an_hour: float) -> Column:
    return latency_ms / 3.6e6 * dollars_an_hour


def shown_discount(paid: Column, listed: Column) -> Column:
    """What was paid, if it differs from the list price by more than half a percent."""
    return F.when(F.abs(paid - listed) / F.when(listed != 0, listed) > 0.005, paid)


def placed_between(value: Column, floor: Column, ceiling: Column) -> Column:
    """Place between floor (0) and ceiling (100), clipped; null if they meet."""
    return 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - floor) / nonzero(ceiling - floor)))


def outcome(standard: Column, scored: Column) -> Column:
    """hit, miss, false_alarm, clear, or open where the standard has no answer."""
    return (
        F.when(standard.isNull() | (standard < 0), "open")
        .when((standard == 1) & (scored == 1), "hit")
        .when(standard == 1, "miss")
        .when(scored == 1, "false_alarm")
        .otherwise("clear")
    )


def invented_probability(gold: Column, power: float, *key: Column | str, scale: float = 0.98) -> Column:
    """A score that depends on the key alone, high where ``gold`` is 1; a larger ``power`` errs less. Steps of 0.001."""
    part = scale * F.pow(uniform(*key), F.lit(power))
    return F.floor(F.when(gold == 1, 1 - part).otherwise(part) * 1000 + 0.5) / 1000


def thresholds(n: int) -> list[float]:
    """The inner cuts of n equal steps."""
    return [i / n for i in range(1, n)]



def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def inverse_normal(p: float) -> float:
    """Quantile of the standard normal."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def d_prime(hits: int, n_signal: int, alarms: int, n_noise: int) -> float:
    """Sensitivity from log-linear corrected rates."""
    return inverse_normal((hits + 0.5) / (n_signal + 1)) - inverse_normal((alarms + 0.5) / (n_noise + 1))


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact test of b against c discordant pairs."""
    n = b + c
    if n == 0:
        return 1.0
    k = min(b, c)
    # Terms of the tail, each as a share of the largest, which is the last; they fall off downwards.
    share, total = 1.0, 1.0
    for i in range(k, 0, -1):
        share *= i / (n - i + 1)
        if share < total * 1e-18:
            break
        total += share
    largest = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * total * math.exp(largest))


def mann_whitney_counts(n1: int, n0: int) -> list[int]:
    """In how many of all orders of n1 and n0 distinct values U is 0, 1, 2 ... n1 * n0.

    The counts of (i, n0) follow from those of (i - 1, n0): times 1 - q^(n0 + i), over 1 - q^i.
    """
    counts = [1] + [0] * (n1 * n0)
    for i in range(1, n1 + 1):
        for k in range(n1 * n0, n0 + i - 1, -1):
            counts[k] -= counts[k - n0 - i]
        for k in range(i, n1 * n0 + 1):
            counts[k] += counts[k - i]
    return counts


def mann_whitney_greater(u: float, n1: int, n0: int, ties: float, exact_up_to: int = 8) -> float | None:
    """One-sided p of U: that group 1 is larger. ``ties``: sum of t^3 - t over tied values.

    Without ties and with a group of ``exact_up_to`` at most it is exact, else normal, corrected for ties and continuity.
    Null for an empty group, or if all values are tied.
    """
    n = n1 + n0
    if not n1 or not n0 or ties >= n**3 - n:
        return None
    if not ties and min(n1, n0) <= exact_up_to:
        counts = mann_whitney_counts(min(n1, n0), max(n1, n0))
        return sum(counts[round(u) :]) / math.comb(n, n1)
    spread = math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
    return 0.5 * math.erfc((u - n1 * n0 / 2 - 0.5) / spread / math.sqrt(2))


#: The rational approximation of the normal quantile (central part, tails), error below 1.2e-9.
QUANTILE_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
QUANTILE_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
QUANTILE_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
QUANTILE_TAIL = 0.02425


def normal_quantile(u: Column) -> Column:
    """The standard normal's quantile at u, which is kept off 0 and 1."""
    def poly(x: Column, coefficients: tuple[float, ...]) -> Column:
        return reduce(lambda s, c: s * x + c, coefficients[1:], F.lit(coefficients[0]))

    u = F.least(F.greatest(u, F.lit(1e-15)), F.lit(1 - 1e-15))
    q = u - 0.5
    tail = lambda v: F.sqrt(-2 * F.log(v))
    end = lambda t: poly(t, QUANTILE_C) / poly(t, QUANTILE_D)
    middle = poly(q * q, QUANTILE_A) * q / poly(q * q, QUANTILE_B)
    return F.when(u < QUANTILE_TAIL, end(tail(u))).when(u > 1 - QUANTILE_TAIL, -end(tail(1 - u))).otherwise(middle)


def normal_quantile_sql(u: str) -> str:
    """``normal_quantile`` in DuckDB SQL."""
    def poly(x: str, coefficients: tuple[float, ...]) -> str:
        return reduce(lambda s, c: f"(({s}) * {x} + {c:.17e})", coefficients[1:], f"{coefficients[0]:.17e}")

    u = f"least(greatest({u}, 1e-15), {1 - 1e-15:.17e})"
    q = f"({u} - 0.5e0)"
    end = lambda t: f"({poly(t, QUANTILE_C)} / {poly(t, QUANTILE_D)})"
    return f"""(CASE WHEN {u} < {QUANTILE_TAIL}e0 THEN {end(f"sqrt(-2 * ln({u}))")} WHEN {u} > {1 - QUANTILE_TAIL}e0 THEN -{end(f"sqrt(-2 * ln(1 - {u}))")}
    ELSE {poly(f"({q} * {q})", QUANTILE_A)} * {q} / {poly(f"({q} * {q})", QUANTILE_B)} END)"""


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared: the incomplete gamma function by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * scale)
    b = h + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * out


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
