"""Column expressions over ARRAY<DOUBLE> distributions and logits.

`let` binds an intermediate value once: without it a nested higher-order function would be
re-evaluated for every element of the array it is used in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scale_to_one(p: Column) -> Column:
    """Divide by the sum (a zero sum leaves the zeros in place)."""
    return let(asum(p), lambda s: F.transform(p, lambda x: x / F.when(s == 0, 1.0).otherwise(s)))


def normalise_or_uniform(p: Column) -> Column:
    """A distribution with no mass counts as uniform."""
    return let(asum(p), lambda s: F.transform(p, lambda x: F.when(s == 0, 1.0 / F.size(p)).otherwise(x / s)))


def softmax(z: Column, t=1.0) -> Column:
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return let(
        F.array_max(z),
        lambda m: let(F.transform(z, lambda x: F.exp((x - m) / t)), lambda e: let(asum(e), lambda s: F.transform(e, lambda x: x / s))),
    )


def lse(z: Column) -> Column:
    """log sum exp; -inf rows stay -inf."""
    return let(F.array_max(z), lambda m: F.when(m == float("-inf"), m).otherwise(m + F.log(asum(F.transform(z, lambda x: F.exp(x - m))))))


def log_softmax(z: Column) -> Column:
    return let(lse(z), lambda s: F.transform(z, lambda x: x - s))


def safe_log(p: Column) -> Column:
    """log p with log 0 = -inf (element-wise)."""
    return F.transform(p, lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf"))))


def argmax(p: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def at(a: Column, i) -> Column:
    """0-based element."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.get(a, i)


def entropy(p: Column) -> Column:
    return -asum(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def certainty(p: Column) -> Column:
    """1 - entropy / log n, at least 0; 1 for a single option."""
    n = F.size(p)
    return F.when(n <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - entropy(p) / F.log(n.cast("double"))))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def choice_confidence(p: Column) -> Column:
    """Top probability rescaled: uniform -> 0, one option certain -> 1."""
    n = F.size(p)
    return let(normalise_or_uniform(p), lambda q: F.when(n <= 1, 1.0).otherwise(clip01((n * F.array_max(q) - 1) / (n - 1))))


def score_confidence(p: Column) -> Column:
    """1 - expected distance from the mode / mean distance of the levels from the middle."""
    n = F.size(p)

    def body(q: Column) -> Column:
        k = argmax(q)
        spread = let(k, lambda kk: asum(F.transform(q, lambda x, i: x * F.abs(i - kk))))
        uniform = asum(F.transform(q, lambda x, i: F.abs(i - (n - 1) / F.lit(2.0)))) / n
        return F.when(n <= 1, 1.0).otherwise(clip01(1.0 - spread / uniform))

    return let(normalise_or_uniform(p), body)


def expected_level(p: Column, levels: Column | None = None) -> Column:
    """Sum of level * p; levels default to 0..n-1."""
    if levels is None:
        return asum(F.transform(p, lambda x, i: x * i))
    return asum(F.zip_with(levels, p, lambda l, x: l * x))


def brier(p: Column, gold: Column) -> Column:
    """Squared distance to the one-hot gold, summed over options."""
    return asum(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), 2)))


def nll(p_gold: Column, eps: float = 1e-12) -> Column:
    return -F.log(F.greatest(p_gold, F.lit(eps)))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * asum(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def max_abs_diff(p: Column, q: Column) -> Column:
    return F.array_max(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    return asum(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(F.greatest(b, F.lit(eps))))).otherwise(0.0)))


def retemper(p: Column, t) -> Column:
    """softmax(log p / T); zero probabilities stay zero."""
    return softmax(safe_log(p), t)


def nll_at(z: Column, gold: Column, t, cap: float = 690.0) -> Column:
    """lse(z/T) - z_gold/T, or the cap when the gold logit is not finite."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    zg = at(z, gold)
    return F.when(zg == float("-inf"), F.lit(cap)).otherwise(lse(F.transform(z, lambda x: x / t)) - zg / t)


def log_p_yes(levels: Column, t) -> Column:
    """log P(yes) of every [no, yes] logit pair at temperature T."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return F.transform(levels, lambda z: F.get(z, F.lit(1)) / t - lse(F.transform(z, lambda x: x / t)))


def nll_isolated_at(levels: Column, gold: Column, t, cap: float = 690.0) -> Column:
    """NLL of an isolated-levels score: per-level log P(yes), renormalised in log space."""
    return let(
        log_p_yes(levels, t),
        lambda lp: F.when(F.get(lp, gold) == float("-inf"), F.lit(cap)).otherwise(lse(lp) - F.get(lp, gold)),
    )


def t_of_options(n: Column, a: float, b: float, lo: float = 0.05) -> Column:
    """T(n) = max(lo, a + b ln n), n read as at least 2."""
    return F.greatest(F.lit(lo), F.lit(a) + F.lit(b) * F.log(F.greatest(n, F.lit(2)).cast("double")))
