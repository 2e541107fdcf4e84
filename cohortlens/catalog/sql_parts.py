"""Small SQL text builders for the equivalent statements."""

from cohortlens.functions.special import NORMAL_MIDDLE, NORMAL_TAIL, TAIL, WALKED
from cohortlens.functions.stats import ERFC_COEFFICIENTS


def p_sql(z: str) -> str:
    """Two-sided normal p-value of the column or expression ``z``."""
    a = f"(abs({z})/sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE/(1.0::DOUBLE+0.5::DOUBLE*{a}))"
    poly = f"({ERFC_COEFFICIENTS[-1]}::DOUBLE)"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c}::DOUBLE+{t}*{poly})"
    return f"({t}*exp(-{a}*{a}+{poly}))"


def t_sql(t: str, df: str) -> str:
    """Two-sided p-value of Student's t: the continued fraction of the incomplete beta function."""
    def fraction(a, b, x):
        first = f"(1 / (1 - ({a} + {b}) * {x} / ({a} + 1)))"
        even = f"(e.m * ({b} - e.m) * {x} / (({a} + 2 * e.m - 1) * ({a} + 2 * e.m)))"
        odd = f"(-({a} + e.m) * ({a} + {b} + e.m) * {x} / (({a} + 2 * e.m) * ({a} + 2 * e.m + 1)))"
        d1, c1 = f"(1 / (1 + {even} * acc.d))", f"(1 + {even} / acc.c)"
        d2, c2 = f"(1 / (1 + {odd} * {d1}))", f"(1 + {odd} / {c1})"
        steps = f"list_transform(range(0, 41 + 3 * ceil(sqrt(greatest({a}, {b})))::BIGINT), lambda k: {{'m': k::DOUBLE, 'c': 1::DOUBLE, 'd': {first}, 'h': {first}}})"
        return f"(list_reduce({steps}, lambda acc, e: {{'m': e.m, 'c': {c2}, 'd': {d2}, 'h': acc.h * {d1} * {c1} * {d2} * {c2}}})).h"

    a, s = f"({df} / 2::DOUBLE)", f"({t} * {t})"
    x, rest = f"({df} / ({df} + {s}))", f"({s} / ({df} + {s}))"
    front = f"exp(-{a} * ln(1 + {s} / {df}) + 0.5::DOUBLE * ln({rest}) - 0.5::DOUBLE * ln(pi()) + lgamma({a} + 0.5::DOUBLE) - lgamma({a}))"
    half = "0.5::DOUBLE"
    return (f"CASE WHEN {df} <= 0 OR {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1 WHEN {x} < ({a} + 1) / ({a} + 2.5::DOUBLE) THEN {front} * {fraction(a, half, x)} / {a} "
            f"ELSE 1 - {front} * {fraction(half, a, rest)} / {half} END")


def polynomial_sql(x: str, coefficients) -> str:
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def normal_quantile_sql(u: str) -> str:
    def tail(p):
        s = f"sqrt(-2 * ln({p}))"
        return f"{polynomial_sql(s, NORMAL_TAIL[0])} / {polynomial_sql(s, NORMAL_TAIL[1])}"

    q = f"({u} - 0.5::DOUBLE)"
    middle = f"{q} * {polynomial_sql(f'({q} * {q})', NORMAL_MIDDLE[0])} / {polynomial_sql(f'({q} * {q})', NORMAL_MIDDLE[1])}"
    return f"CASE WHEN {u} < {TAIL}::DOUBLE THEN {tail(u)} WHEN {u} > 1 - {TAIL}::DOUBLE THEN -({tail(f'(1 - {u})')}) ELSE {middle} END"


def z_prop(n1, p1, n2, p2) -> str:
    return (f"(({p2}-{p1})/nullif(sqrt({p2}*(1-{p2})/nullif({n2}-1,0)+{p1}*(1-{p1})/nullif({n1}-1,0)),0))")


def z_mean(n1, m1, v1, n2, m2, v2) -> str:
    return f"(({m2}-{m1})/nullif(sqrt({v2}/nullif({n2},0)+{v1}/nullif({n1},0)),0))"


THRESHOLD = """thr AS (SELECT score AS t FROM (
  SELECT score, row_number() OVER (ORDER BY score) AS rn FROM scores_v WHERE valid=0)
  WHERE rn = (SELECT greatest(sum(1-y),1) FROM scores_v WHERE valid=0)),
tested AS (SELECT s.*, CASE WHEN score > (SELECT t FROM thr) THEN 1 ELSE 0 END AS pred,
  (SELECT t FROM thr) AS threshold FROM scores_v s WHERE valid=1)"""


def versus(columns: str, tests: dict, by: str = "", group: str = "grp") -> str:
    """SELECT adding p-value columns against the reference row of table ``t``; ``tests``: name -> z builder."""
    part = f"PARTITION BY {by}" if by else ""
    ref = lambda c: f"max(CASE WHEN {group}='white' THEN {c} END) OVER ({part})"
    inner = ", ".join(f"{z(ref)} AS z_{n}" for n, z in tests.items())
    outer = ", ".join(f"CASE WHEN {group} NOT IN ('white','overall') THEN {p_sql('z_' + n)} END AS {n}" for n in tests)
    return f"SELECT {columns}, {outer} FROM (SELECT *, {inner} FROM t)"
