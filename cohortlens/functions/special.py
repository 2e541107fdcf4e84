"""Special functions as column expressions: incomplete beta function, Student's t, normal and Poisson quantiles.

Loops are ``aggregate`` over a sequence whose length follows from the arguments, so a value costs a few dozen steps for small
arguments and some square roots of them for large ones. They are meant for group-level tables.
"""

import math

from pyspark.sql import Column, functions as F

# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
# Coefficients of the ratio gamma(a + 1/2) / gamma(a) over sqrt(a), in powers of 1/a.
HALF_STEP = [1, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144]
# Rational approximation of the normal quantile (relative error below 1.2e-9), in the middle and in the tails.
NORMAL_MIDDLE = ([-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239],
                 [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0])
NORMAL_TAIL = ([-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783],
               [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0])
TAIL = 0.02425
#: Poisson means up to this are walked through, larger ones expanded around the normal distribution.
WALKED = 16


def polynomial(x: Column, coefficients) -> Column:
    """Highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def log_gamma(x: Column, shift: int = 10) -> Column:
    """ln gamma(x) of a positive x, by Stirling's series at x + ``shift``."""
    y = x + shift
    below = F.lit(0.0)
    for k in range(shift):
        below = below + F.log(x + k)
    series = polynomial(1 / (y * y), STIRLING[::-1]) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _log_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)), without the difference of two large numbers where a is large."""
    far = 0.5 * F.log(a) + F.log(polynomial(1 / a, HALF_STEP[::-1]))
    return F.when(a > 200, far).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards."""
    steps = (F.lit(40) + 3 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int")
    first = 1 / (1 - (a + b) * x / (a + 1))

    def step(acc, k):
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / (1 + even * acc["d"]), 1 + even / acc["c"]
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (acc["h"] * d1 * c1 * d2 * c2).alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["h"])


def incomplete_beta(a: Column, b: Column, x: Column, log_beta: Column | None = None) -> Column:
    """The regularised incomplete beta function I_x(a, b); missing where a or b is not positive or x is outside [0, 1]."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    log_beta = log_gamma(a) + log_gamma(b) - log_gamma(a + b) if log_beta is None else log_beta
    front = F.exp(a * F.log(x) + b * F.log1p(-x) - log_beta)
    low = x < (a + 1) / (a + b + 2)
    inside = F.when(low, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when((a > 0) & (b > 0), F.when(x == 0, 0.0).when(x == 1, 1.0).when((x > 0) & (x < 1), inside))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom; missing for none. Good to 1e-9 up to a million degrees,
    to 1e-8 beyond."""
    df, square = df.cast("double"), (t * t).cast("double")
    a, b = df / 2, F.lit(0.5)
    log_beta = F.lit(0.5 * math.log(math.pi)) - _log_half_step(a)
    x, rest = df / (df + square), square / (df + square)
    # ln x from the ratio, which stays exact where x is close to 1.
    front = F.exp(-a * F.log1p(square / df) + 0.5 * F.log(rest) - log_beta)
    low = x < (a + 1) / (a + 2.5)
    p = F.when(low, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, rest) / 0.5)
    return F.when(df > 0, F.when(square == 0, 1.0).when(F.isnan(square) | square.isNull(), None).when(square == math.inf, 0.0).otherwise(p))


def normal_quantile(u: Column) -> Column:
    """The value that a standard normal variable stays below with probability ``u`` (between 0 and 1)."""
    q = u - 0.5
    middle = q * polynomial(q * q, NORMAL_MIDDLE[0]) / polynomial(q * q, NORMAL_MIDDLE[1])

    def tail(p):
        s = F.sqrt(-2 * F.log(p))
        return polynomial(s, NORMAL_TAIL[0]) / polynomial(s, NORMAL_TAIL[1])

    return F.when(u < TAIL, tail(u)).when(u > 1 - TAIL, -tail(1 - u)).otherwise(middle)


def poisson_quantile(u: Column, mean: Column) -> Column:
    """The smallest k that a Poisson variable stays at or below with probability ``u`` or more, so uniform ``u`` give draws."""
    mean = mean.cast("double")
    first = F.exp(-mean)
    steps = (mean + 8 * F.sqrt(mean) + 16).cast("int")

    def step(acc, k):
        term = acc["term"] * mean / k
        go = acc["upto"] < u
        return F.when(go, F.struct(term.alias("term"), (acc["upto"] + term).alias("upto"), k.cast("long").alias("k"))).otherwise(acc)

    start = F.struct(first.alias("term"), first.alias("upto"), F.lit(0).cast("long").alias("k"))
    walked = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["k"])
    w = normal_quantile(u)
    root = F.sqrt(mean)
    far = mean + root * w + (F.lit(1 / 3) + w * w / 6) - (w / 36 + w * w * w / 72) / root + polynomial(
        w * w, [1 / 270, 7 / 810, -8 / 405]) / mean
    return F.when(mean <= 0, 0).when(mean <= WALKED, walked).otherwise(F.greatest(F.floor(far), F.lit(0))).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a digest of the parts: 52 bits, never an end."""
    digest = F.md5(F.concat_ws("#", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
