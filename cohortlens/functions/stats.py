"""Normal tail and z-tests as column expressions."""

from pyspark.sql import Column, functions as F

from cohortlens.functions.nulls import ratio

# Chebyshev coefficients of the complementary error function (relative error < 1.2e-7).
ERFC_COEFFICIENTS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                     0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    a = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * a)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-a * a + poly)


def normal_cdf(z: Column) -> Column:
    tail = two_sided_p(z) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def z_proportions(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    spread = F.try_add(ratio(p2 * (1 - p2), n2 - 1), ratio(p1 * (1 - p1), n1 - 1))
    return ratio(p2 - p1, F.sqrt(spread))


def z_means(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    return ratio(m2 - m1, F.sqrt(ratio(v2, n2) + ratio(v1, n1)))


def p_proportions(n1, p1, n2, p2) -> Column:
    return two_sided_p(z_proportions(n1, p1, n2, p2))


def p_means(n1, m1, v1, n2, m2, v2) -> Column:
    return two_sided_p(z_means(n1, m1, v1, n2, m2, v2))
