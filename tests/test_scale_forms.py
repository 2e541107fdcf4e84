"""Level dictionaries, checked writes, buckets, quotas from counts, pruned search, ledgers and special functions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import special
from cohortlens.functions.codes import COLLEGE_CODES, college_code, seeded_key
from cohortlens.operators import joins, quotas, sampling
from cohortlens.operators.levels import encode_levels, fit_levels
from cohortlens.plans import courses, ledger, measures, students, swap
from cohortlens.sources.buckets import bucketed, exchanges
from cohortlens.sources.contracts import ContractError, write_checked
from cohortlens.sources.scan import sink, work_folder


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- levels

def test_levels_of_the_data(spark):
    df = spark.createDataFrame([("A B", 1), ("a_b", 1), ("A B", None), ("x", 2), (None, 2), ("", 2)], "c string, k int")
    levels = fit_levels(df, {"c": "x", "k": None})
    got = {(r.variable, r.level): (r.n, r.column) for r in levels.collect()}
    assert got == {("c", "A B"): (2, "c_a_b"), ("c", "a_b"): (1, "c_a_b_2"), ("c", "x"): (1, None), ("c", "missing"): (1, "c_missing"),
                   ("c", ""): (1, "c_"), ("k", "1"): (2, "k_1"), ("k", "2"): (3, "k_2"), ("k", "missing"): (1, "k_missing")}
    assert {r.share for r in levels.where("variable = 'k' AND level = '1'").collect()} == {2 / 6}


def test_rare_and_unseen_levels(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 10 + [("c",), ("d",)], "v string")
    levels = fit_levels(df, {"v": "a"}, least_share=0.1)
    later = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("new",), (None,)], "v string")
    plain = encode_levels(later, levels)
    assert plain.columns == ["v_b", "v_rare"]
    assert [tuple(r) for r in plain.collect()] == [(0, 0), (1, 0), (0, 1), (0, 1), (0, 0), (0, 0)]
    assert [tuple(r) for r in encode_levels(later, levels, "rare", keep=True).collect()][4:] == [("new", 0, 1), (None, 0, 1)]
    assert encode_levels(df, levels, "error").count() == 20
    with pytest.raises(Exception, match="not fitted"):
        encode_levels(later, levels, "error").collect()
    with pytest.raises(ValueError):
        encode_levels(later, fit_levels(df, {"v": "a"}), "rare")
    with pytest.raises(ValueError, match="more than 2"):
        encode_levels(later, levels, most=2)
    empty = fit_levels(df.limit(0), {"v": "a"})
    assert encode_levels(later, empty).columns == ["v"]


def test_college_codes(spark):
    df = spark.createDataFrame([("Danville",), ("J. Sargeant Reynolds",), ("nowhere",), (None,)], "c string")
    assert [r[0] for r in df.select(college_code(F.col("c"))).collect()] == ["DCC", "JSRCC", None, None]
    assert len(COLLEGE_CODES) == len(set(COLLEGE_CODES.values())) == 23


# ---- contracts of a write

def test_checked_write(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    table, report = write_checked(df, work_folder(spark), ["k", "t"], ["k"], {"odd": F.col("k") == 1})
    assert report == {"rows": 3, "repeated": 0, "null k": 0, "odd": 2} and rows_of(table) == rows_of(df)
    for broken in (dict(unique="k"), dict(not_null=["v"]), dict(counts={"odd": F.col("k") == 1}, none_of=["odd"])):
        with pytest.raises(ContractError) as error:
            write_checked(df, work_folder(spark), **broken)
        assert error.value.report["rows"] == 3 and spark.read.parquet(error.value.path).count() == 3
    assert write_checked(df.limit(0), work_folder(spark), "k", ["v"])[1] == {"rows": 0, "repeated": 0, "null v": 0}


def test_assembly_reports_what_is_missing(spark):
    base = spark.createDataFrame([(i,) for i in range(6)], "id int")
    one = spark.createDataFrame([(i, i * 2) for i in range(5)], "id int, x int")
    two = spark.createDataFrame([(i, i * 3) for i in range(3, 9)], "id int, y int")
    blocks = {"one": (one, ["id"]), "two": (two, ["id"])}
    table, report = joins.assemble_checked(base, blocks, work_folder(spark), "id")
    assert rows_of(table) == [(3, 6, 9), (4, 8, 12)]
    assert report == {"rows": 2, "repeated": 0, "null id": 0, "null x": 0, "null y": 0, "without one": 1, "without two": 3}
    wide, report = joins.assemble_checked(base, blocks, work_folder(spark), "id", required=False, complete=False)
    assert wide.count() == 6 and report["without two"] == 3
    with pytest.raises(ContractError):
        joins.assemble_checked(base, blocks, work_folder(spark), "id", required=False)
    twice = {"one": (one.union(one), ["id"])}
    with pytest.raises(ContractError, match="repeated"):
        joins.assemble_checked(base, twice, work_folder(spark), "id")


# ---- buckets

def test_buckets_are_joined_and_grouped_without_an_exchange(spark):
    a = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    b = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    left, right = bucketed(a, work_folder(spark), "k", 4), bucketed(b, work_folder(spark), "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.groupBy("k").agg(F.sum("x").alias("x")).join(right, "k", "left")
        assert exchanges(joined) == 0 and exchanges(a.groupBy("k").count().join(b, "k")) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows_of(joined) == rows_of(a.groupBy("k").agg(F.sum("x").alias("x")).join(b, "k", "left"))


def test_student_features_shuffle_nothing(spark):
    from cohortlens.catalog import student_features as catalog
    from cohortlens.sources.tables import Records

    r = Records(spark, "/root/testdata/sf0.001")
    aid = r.aid.groupBy("student").agg(F.sum("grants").alias("grants_all"))
    tables = students.student_tables(catalog.term_record_of(r), catalog.repeats_of(r), aid, work_folder(spark), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        features = students.student_features(tables)
        assert exchanges(features) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert features.count() == tables["terms"].select("student").distinct().count()


def test_grades_are_filled_with_one_shuffle(spark):
    df = spark.createDataFrame([(1, 2, "c", "M", "101L", 3.0, None), (1, 2, "c", "M", "101", 3.0, "A"), (1, 2, "d", "M", "101", 3.0, ""),
                                (2, 2, "c", "M", "101", 0.0, None), (3, 2, "c", "M", "101", 3.0, "B"), (3, 2, "c", "M", "101", 3.0, "C"),
                                (3, 2, "c", "M", "101", 3.0, None)], "student int, strm int, college string, subject string, course_num string, credit double, grade string")
    filled = courses.fill_grades(df)
    assert exchanges(filled) == 1 and exchanges(filled.groupBy("student", "strm").count()) == 1
    assert sorted((r.student, r.college, r.grade or "-") for r in filled.collect()) == [
        (1, "c", "A"), (1, "c", "A"), (1, "d", "A"), (3, "c", "-"), (3, "c", "B"), (3, "c", "C")]


# ---- quotas

def one_by_one(entities, quota, keys):
    used, out, carry = set(), {}, 0
    for b in sorted(quota, reverse=True):
        need = quota[b] + carry
        pool = sorted((keys[e], e) for e, bits in entities.items() if b in bits and e not in used)
        taken = [e for _, e in pool[:max(need, 0)]]
        carry = max(need - len(pool), 0)
        used.update(taken)
        out.update(dict.fromkeys(taken, b))
    return out


@pytest.mark.parametrize("most", [20_000, 40, 3])
def test_quotas_from_counts_equal_the_sequence(spark, most, monkeypatch):
    rng = random.Random(most)
    people = {c: {f"{c}{i}": set(rng.sample(range(1, 18), rng.randint(1, 5))) for i in range(n)} for c, n in ((0, 900), (1, 300))}
    wanted = {0: {b: rng.randint(0, 60) for b in range(1, 18)}, 1: {b: rng.choice([0, 5, 200]) for b in range(1, 18)}}
    df = spark.createDataFrame([(e, c, b) for c, p in people.items() for e, bits in p.items() for b in bits], "id string, cohort int, nth int")
    monkeypatch.setattr(sampling, "thresholds", lambda *a: quotas.thresholds(*a, most))
    got = {r.id: r.new_nth for r in sampling.truncation_sample(df, wanted, "id", "nth", "cohort", 7).collect()}
    keys = {r.id: f"{r.k}#{r.id}" for r in df.select("id", seeded_key(7, F.col("id")).alias("k")).distinct().collect()}
    expected = {}
    for c in people:
        expected |= one_by_one(people[c], wanted[c], keys)
    assert got == expected


def test_the_number_of_jobs_does_not_follow_the_buckets(spark, monkeypatch):
    looks = []
    monkeypatch.setattr(quotas, "_closer", lambda *a, f=quotas._closer: looks.append(1) or f(*a))
    rng = random.Random(1)
    for n_buckets in (3, 40):
        rows = [(i, 0, b) for i in range(500) for b in rng.sample(range(1, n_buckets + 1), 2)]
        df = spark.createDataFrame(rows, "id int, cohort int, nth int")
        sampling.truncation_sample(df, {0: {b: 500 // n_buckets for b in range(1, n_buckets + 1)}}, "id", "nth", "cohort").count()
    assert len(looks) == 2
    empty = spark.createDataFrame([], "id int, cohort int, nth int")
    assert sampling.truncation_sample(empty, {0: {1: 5}}, "id", "nth", "cohort").count() == 0
    assert sampling.truncation_sample(df, {}, "id", "nth", "cohort").count() == 0


# ---- first crossing

def staircase(rng, n, drift):
    out, total = [], 0
    for k in range(1, n + 1):
        total += rng.random() < drift(k / n)
        out.append(total)
    return out


@pytest.mark.parametrize("ranges, ahead", [(4096, 4), (8, 1), (3, 2)])
def test_pruned_search_equals_the_loop(spark, ranges, ahead):
    rng = random.Random(ranges)
    ref, tgt = staircase(rng, 400, lambda s: 0.3 + 0.5 * s), staircase(rng, 260, lambda s: 0.1 + 0.7 * s)
    rows = [("white", k, c) for k, c in enumerate(ref, 1)] + [("afam", k, c) for k, c in enumerate(tgt, 1)]
    ranked = sink(spark.createDataFrame(rows, "grp string, k long, cum_y long").repartition(3), work_folder(spark))
    sizes = [(20, 100), (0, 399), (100, 150), (250, 300), (259, 400), (10, 2), (None, 5), (260, 400), (0, 1)]

    def plain(n1, n2):
        for j in range(2, len(tgt) + 1):
            if n1 is None or n1 + j > len(tgt) or n2 - j < 1:
                return None
            if tgt[n1 + j - 1] / (n1 + j) >= ref[n2 - j - 1] / (n2 - j):
                return j
        return None

    got = swap.first_crossings(ranked, sizes, "white", "afam", ranges, ahead)
    assert [g and g[0] for g in got] == [plain(*s) for s in sizes]
    assert all(g is None or g[1:3] == (s[0] + g[0], s[1] - g[0]) for g, s in zip(got, sizes))
    assert swap.first_crossings(ranked.where("k > 1000"), [(3, 4)], "white", "afam") == [None]


def test_most_ranges_are_never_looked_at():
    n, step = 4096, 10
    rate = np.linspace(0.2, 0.8, n)
    kept = swap.candidate_ranges(1000, 30_000, step, (n * step, rate - 0.01, rate), (n * step, rate, rate + 0.01))
    assert 0 < len(kept) < n and kept[0][0] > 10_000  # nothing before the rates come near each other


# ---- ledger

@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(21)
    groups = ["white", "afam", "hisp"]
    data = [(i, groups[i % 3], int(rng.random() < 0.3 + 0.4 * (s := rng.randint(0, 400) / 400)), s, i % 2) for i in range(1500)]
    return spark.createDataFrame(data, "id int, grp string, y int, score double, valid int")


def near(a, b):
    assert a.columns == b.columns
    x, y = rows_of(a.select(*sorted(a.columns))), rows_of(b.select(*sorted(b.columns)))
    assert len(x) == len(y)
    for r, s in zip(x, y):
        assert [v if isinstance(v, str) or v is None else pytest.approx(v, rel=1e-9, abs=1e-12) for v in s] == list(r)


def test_ledger_gives_what_the_rows_give(spark, scored):
    l = ledger.ledger(scored, ["valid", "grp"], work_folder(spark))
    train, test = scored.where("valid = 0"), scored.where("valid = 1")
    held, fitted = l.where("valid = 1"), l.where("valid = 0")
    rows, cells = measures.with_threshold(test, train), held.with_threshold(fitted)
    near(ledger.auc(l, ["valid", "grp"]), measures.auc(scored, ["valid", "grp"]))
    near(ledger.auc(l), measures.auc(scored))
    near(ledger.base_rate_threshold(fitted), measures.base_rate_threshold(train))
    for name in ("success_rates", "tpr_bias", "fpr_precision0_bias", "bas_bias"):
        near(getattr(ledger, name)(cells), getattr(measures, name)(rows))
    near(ledger.balanced_accuracy(cells, "grp"), measures.balanced_accuracy(rows, "grp"))
    near(ledger.class_report(cells, "grp"), measures.class_report(rows, "grp"))
    near(ledger.score_bias(l, "valid"), measures.score_bias(scored, "valid"))
    near(ledger.calibration_curve(held, 10), measures.calibration_curve(test, 10))
    near(ledger.parity_at(held), measures.parity_at(test).select("pct", "grp", "n", "rate", "p_value"))
    near(ledger.precision0_tnr(held), measures.precision0_tnr(test))
    near(ledger.pr_threshold(l, "valid"), measures.pr_threshold(scored, "valid"))
    near(ledger.pr_threshold(fitted), measures.pr_threshold(train))


def test_ledger_reads_no_rows_again(spark, scored):
    path = work_folder(spark)
    source = sink(scored, f"{path}/rows")
    l = ledger.ledger(source, ["valid", "grp"], f"{path}/ledger")
    plan = ledger.report(l, F.col("valid") == 0, F.col("valid") == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert f"{path}/rows" not in plan and l.cells.count() == scored.select("valid", "grp", "score").distinct().count()
    with pytest.raises(ValueError, match="repeat"):
        ledger.calibration_curve(ledger.ledger(scored.withColumn("score", F.lit(0.5)), "grp", work_folder(spark)), 10)


# ---- special functions

def t_tail(t, df, steps=200_000):
    """Two-sided tail by Simpson's rule over the angle."""
    a, b = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    x = np.linspace(a, b, steps + 1)
    y = np.cos(x).clip(0) ** (df - 1)
    simpson = (b - a) / steps / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 2 * simpson * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_student_t(spark):
    cases = [(t, df) for t in (0.1, 0.7, 1.0, 2.5, -4.0, 12.0, 40.0) for df in (1, 2, 3, 7, 30, 150, 500, 2500)]
    got = spark.createDataFrame(cases, "t double, df int").select(special.t_two_sided_p(F.col("t"), F.col("df"))).collect()
    for (t, df), r in zip(cases, got):
        assert r[0] == pytest.approx(t_tail(t, df), rel=1e-8, abs=1e-13)
    known = {(1.0, 1): 0.5, (12.706204736174694, 1): 0.05, (4.302652729749462, 2): 0.05, (2.2281388519862735, 10): 0.05, (1.9623391, 1000): 0.05}
    got = spark.createDataFrame(list(known), "t double, df int").select(special.t_two_sided_p(F.col("t"), F.col("df"))).collect()
    assert [r[0] for r in got] == pytest.approx(list(known.values()), rel=1e-6)
    edge = spark.createDataFrame([(0.0, 5), (2.0, 0), (None, 5), (float("inf"), 3)], "t double, df int")
    assert [r[0] for r in edge.select(special.t_two_sided_p(F.col("t"), F.col("df"))).collect()] == [1.0, None, None, 0.0]
    # Many degrees of freedom: the normal tail and the first term of its expansion; the fraction loses digits there.
    t, density = 1.959963984540054, 0.058445069805035
    many = spark.createDataFrame([(t, 10**5), (t, 10**6), (t, 10**9)], "t double, df long").select("df", special.t_two_sided_p(F.col("t"), F.col("df")))
    for r in many.collect():
        assert r[1] == pytest.approx(0.05 + 2 * density * (t**3 + t) / (4 * r.df), abs=1e-10 if r.df == 10**5 else 1e-9 if r.df == 10**6 else 1e-8)


def test_incomplete_beta(spark):
    # I_x(a, b) of whole numbers is a binomial tail.
    cases = [(a, b, x) for a in (1, 2, 5, 40) for b in (1, 3, 60) for x in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0)]
    got = spark.createDataFrame(cases, "a int, b int, x double").select(special.incomplete_beta(F.col("a"), F.col("b"), F.col("x"))).collect()
    for (a, b, x), r in zip(cases, got):
        n = a + b - 1
        assert r[0] == pytest.approx(sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1)), rel=1e-9, abs=1e-14)
    odd = spark.createDataFrame([(0.0, 1.0, 0.5), (1.0, 1.0, 1.5), (1.0, None, 0.5)], "a double, b double, x double")
    assert [r[0] for r in odd.select(special.incomplete_beta(F.col("a"), F.col("b"), F.col("x"))).collect()] == [None] * 3


def test_quantiles_of_the_normal_and_poisson(spark):
    from statistics import NormalDist

    us = [1e-12, 0.001, 0.02, 0.3, 0.5, 0.77, 0.98, 1 - 1e-9]
    got = spark.createDataFrame([(u,) for u in us], "u double").select(special.normal_quantile(F.col("u"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(u) for u in us], rel=2e-9, abs=1e-9)

    def plain(u, mean):
        k, term = 0, math.exp(-mean)
        upto = term
        while upto < u:
            k += 1
            term *= mean / k
            upto += term
        return k

    cases = [(u, m) for u in (0.0001, 0.2, 0.5, 0.8123, 0.99999) for m in (0, 1, 2, 10, 64, 65, 200, 500)]
    got = spark.createDataFrame(cases, "u double, m int").select(special.poisson_quantile(F.col("u"), F.col("m"))).collect()
    off = [abs(r[0] - plain(u, m)) for (u, m), r in zip(cases, got)]
    assert all(d == 0 for d, (_, m) in zip(off, cases) if m <= special.WALKED) and max(off) <= 1 and sum(off) <= 2


def test_draws_have_the_distribution(spark):
    draws = spark.range(20_000).select(special.uniform(F.lit("s"), F.col("id")).alias("u")).select(
        *[special.poisson_quantile(F.col("u"), F.lit(m)).alias(f"m{m}") for m in (1, 30, 1000)]).toPandas()
    for m in (1, 30, 1000):
        assert draws[f"m{m}"].mean() == pytest.approx(m, abs=4 * math.sqrt(m / 20_000))
        assert draws[f"m{m}"].var() == pytest.approx(m, rel=0.06)
    assert Counter(draws["m1"])[0] / 20_000 == pytest.approx(math.exp(-1), abs=0.015)


def test_bootstrap_work_does_not_follow_the_rows(spark):
    rows = spark.range(40_000).select(F.lit("g").alias("grp"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    r = measures.bootstrap_ci(rows, "grp", "y", b=400).first()
    se = math.sqrt(0.25 * 0.75 / 40_000)
    assert r.low < 0.25 < r.high and r.high - r.low == pytest.approx(2 * 1.96 * se, rel=0.2)
