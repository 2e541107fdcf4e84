"""Missing-value rules, ties, empty groups and brute-force checks on small hand-made frames."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.codes import seeded_key
from cohortlens.functions.grades import clean_course_number
from cohortlens.functions.nulls import above, below, in_list, ratio
from cohortlens.functions.stats import two_sided_p
from cohortlens.functions.terms import nth_term, possible_main_terms, previous_term, term_at
from cohortlens.operators import aggs, joins, ranking, reshape, rows, sampling
from cohortlens.operators import windows as w
from cohortlens.plans import courses, measures, models
from cohortlens.sources.contracts import assert_no_nulls, assert_unique
from cohortlens.sources.scan import cut_lineage, scan_csv_dir, sink, work_folder


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def test_missing_compares_as_largest_and_blank(spark):
    df = spark.createDataFrame([(1, 5, "A"), (2, None, None)], "id int, x int, s string")
    out = df.select("id", below(F.col("x"), 9).alias("b"), above(F.col("x"), 9).alias("a"), (~in_list(F.col("s"), ["A"])).alias("n"))
    assert sorted(values(out, "id", "b", "a", "n")) == [(1, True, False, False), (2, False, True, True)]


def test_zero_denominator_is_missing(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("r")).first()["r"] is None


def test_drop_if_keeps_unknown_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "id int, x int")
    assert sorted(values(rows.drop_if(df, F.col("x") == 1), "id")) == [(2,), (3,)]


def test_course_numbers(spark):
    df = spark.createDataFrame([("1234L",), ("123L",), ("123",), ("1",), ("12L",)], "n string")
    assert [r[0] for r in df.select(clean_course_number(F.col("n"))).collect()] == ["234", "123", "123", "1", "12L"]


GRADES = "student int, strm int, college string, subject string, course_num string, section int, credit double, grade string"


def test_fill_grades(spark):
    df = spark.createDataFrame([
        (1, 2122, "x", "MTH", "101", 1, 3.0, "A"), (1, 2122, "x", "MTH", "101", 2, 3.0, None),
        (2, 2122, "x", "MTH", "101", 1, 3.0, "A"), (2, 2122, "x", "MTH", "101", 2, 3.0, "B"), (2, 2122, "x", "MTH", "101", 3, 3.0, None),
        (3, 2122, "x", "MTH", "101", 1, 3.0, "C"), (3, 2122, "y", "MTH", "101", 1, 3.0, None),
        (4, 2122, "x", "MTH", "101", 1, 0.0, None)], GRADES)
    got = {(r.student, r.college, r.section): r.grade for r in courses.fill_grades(df).collect()}
    assert got[(1, "x", 2)] == "A" and got[(2, "x", 3)] is None and got[(3, "y", 1)] == "C" and (4, "x", 1) not in got


@pytest.mark.parametrize("ties,expected", [("null", {1: None, 2: "y", 3: None}), ("min", {1: "x", 2: "y", 3: None}), ("max", {1: "y", 2: "y", 3: None})])
def test_mode(spark, ties, expected):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "y"), (3, None), (3, None)], "k int, x string")
    assert dict(values(aggs.mode_by(df, "k", "x", ties), "k", "x")) == expected


def test_multiple_mode(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, None), (3, None)], "k int, x int")
    assert dict(values(aggs.multiple_mode(df, "k", "x", 8, "m"), "k", "m")) == {1: 8, 2: 1, 3: None}


def test_fills_differ(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, None), (1, 4, 7)], "id int, strm int, x int")
    out = df.select("strm", w.locf("x", "id").alias("f"), w.nocb("x", "id").alias("b"), w.fill_prev_once("x", "id").alias("o"),
                    w.fill_first_known("x", "id").alias("k")).orderBy("strm")
    assert values(out, "f", "b", "o", "k") == [(5, 5, 5, 5), (5, 7, 5, 5), (5, 7, None, 5), (7, 7, 7, 7)]


def brute_trend(past):
    if len(past) < 2:
        return 0.0
    if len(past) == 2:
        return past[1] - past[0]
    best = None
    for i in range(len(past) - 2):
        x, y = np.arange(i, len(past), dtype=float), np.array(past[i:])
        slope = np.polyfit(x, y, 1)[0]
        total = ((y - y.mean()) ** 2).sum()
        fit = np.polyval(np.polyfit(x, y, 1), x)
        r2 = 1.0 if total < 1e-12 else 1 - ((y - fit) ** 2).sum() / total
        if best is None or round(r2, 9) > best[0]:
            best = (round(r2, 9), 0.0 if total < 1e-12 else slope)
    return best[1]


def test_best_suffix_trend(spark):
    rng = random.Random(1)
    data = [(i, t, None if rng.random() < 0.1 else float(rng.randint(0, 8)) / 2) for i in range(40) for t in range(1, rng.randint(2, 9))]
    data += [(100, 1, 2.0), (100, 2, 2.0), (100, 3, 2.0), (100, 4, 2.0)]
    df = spark.createDataFrame(data, "id int, strm int, x double")
    got = {(r.id, r.strm): r.trend for r in w.best_suffix_trend(df, "id", "strm", "x").collect()}
    for i, part in groupby(sorted(data, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        past = []
        for _, t, x in part:
            assert got[(i, t)] == pytest.approx(brute_trend(past), abs=1e-8)
            if x is not None:
                past.append(x)


def test_terms(spark):
    first = spark.createDataFrame([(2122,), (2123,), (2124,)], "f int")
    df = first.select("f", F.explode(F.sequence(F.lit(1), F.lit(18))).alias("n")).withColumn("s", term_at(F.col("f"), F.col("n")))
    out = df.select("n", "s", nth_term(F.col("f"), F.col("s")).alias("back")).collect()
    assert all(r.n == r.back and r.s % 10 in (2, 3, 4) for r in out)
    assert values(spark.createDataFrame([(2122,), (2123,)], "s int").select(previous_term(F.col("s")).alias("p")), "p") == [(2114,), (2122,)]


def test_possible_main_terms_counts_fall_and_spring(spark):
    codes = [10 * y + t for y in range(212, 216) for t in (2, 3, 4)]
    df = spark.createDataFrame([(a, b) for a in codes for b in codes if a <= b], "a int, b int")
    for r in df.select("a", "b", possible_main_terms(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == sum(1 for c in codes if r.a <= c < r.b and c % 10 != 3), r


def test_short_late_spring_spell_has_no_term(spark):
    df = spark.sql("select 1 as id, date'2015-05-10' as begin_date, date'2015-05-20' as end_date union all select 2, date'2015-12-20', date'2016-01-05'")
    assert sorted(values(joins.spells_to_terms(df, (2000, 2030)), "id", "strm")) == [(2, 2154), (2, 2162)]


def test_prior_features_ignore_later_terms(spark):
    rng = random.Random(3)
    data = [(i, t, float(rng.randint(1, 4))) for i in range(10) for t in range(1, 8)]
    df = spark.createDataFrame(data, "student int, strm int, x double")
    feats = lambda d: d.select("student", "strm", w.prior_share("x", "x", "student").alias("a"), w.expanding_sd("x", "student").alias("b"),
                               w.lag_term("x", 1, "student").alias("c"), w.ever("x", "student", inclusive=False).alias("d"))
    whole = {r[:2]: r[2:] for r in map(tuple, feats(df).collect())}
    cut = {r[:2]: r[2:] for r in map(tuple, feats(df.where("strm <= 4")).collect())}
    assert all(whole[k] == v for k, v in cut.items())


def test_totals_before_equals_pairs(spark):
    rng = random.Random(5)
    hist = [(rng.randint(0, 5), rng.randint(1, 9), float(rng.randint(0, 4))) for _ in range(200)]
    target = [(i, t) for i in range(7) for t in range(1, 11)] + [(0, 3)]
    got = values(joins.totals_before(spark.createDataFrame(target, "id int, t int"), spark.createDataFrame(hist, "id int, t int, x double"), ["id"], "t", {"s": "x"}),
                 "id", "t", "s", "rows_before")
    assert len(got) == len(target)
    for i, t, s, n in got:
        past = [x for a, b, x in hist if a == i and b < t]
        assert (s, n) == ((sum(past), len(past)) if past else (None, None))


def test_leave_one_out_equals_pairs(spark):
    rng = random.Random(7)
    data = [(i, k, float(rng.randint(0, 4)), float(rng.randint(1, 4))) for i in range(6) for k in range(rng.randint(1, 5))]
    got = {(r.id, r.k): r.o for r in w.leave_one_out(spark.createDataFrame(data, "id int, k int, x double, c double"), "id", "x", "c", "o").collect()}
    for i, k, _, _ in data:
        others = [(x, c) for a, b, x, c in data if a == i and b != k]
        expected = sum(x * c for x, c in others) / sum(c for _, c in others) if others else None
        assert got[(i, k)] == (pytest.approx(expected) if others else None)


def scored(spark, n=200, seed=11, hot=0.0, one_class=False):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        s = 0.5 if rng.random() < hot else round(rng.random(), 2)
        grp = "white" if rng.random() < max(hot, 0.5) else "afam"
        data.append((i, grp, 1 if one_class else int(rng.random() < 0.3 + 0.5 * s), s))
    return data, spark.createDataFrame(data, "id int, grp string, y int, score double")


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_auc_equals_pairs(spark, hot):
    data, df = scored(spark, 150, hot=hot)
    pos, neg = [r[3] for r in data if r[2]], [r[3] for r in data if not r[2]]
    expected = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg])
    assert measures.auc(df).first()["auc"] == pytest.approx(expected)


def test_single_class_has_no_auc(spark):
    assert measures.auc(scored(spark, 20, one_class=True)[1]).first()["auc"] is None


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_quantiles_equal_numpy(spark, hot):
    data, df = scored(spark, 137, seed=2, hot=hot)
    probs = [0.1, 0.25, 0.33, 0.5, 0.9]
    got = sorted(values(ranking.quantiles(df, [], "score", probs), "prob", "q"))
    assert [q for _, q in got] == pytest.approx(list(np.quantile([r[3] for r in data], probs)))


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_ordinal_rank_is_a_total_order(spark, hot):
    _, df = scored(spark, 300, seed=4, hot=hot)
    keyed = {r.id: r.k for r in df.select("id", seeded_key(9, F.col("id")).alias("k")).collect()}
    got = ranking.ordinal_rank(df, [], "score", "id", 9, "rank", {"y": "y"}).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))
    order = sorted(got, key=lambda r: (r.score, keyed[r.id]))
    assert [r.id for r in order] == [r.id for r in got]
    assert [r.cum_y for r in got] == list(np.cumsum([r.y for r in got]))


def brute_swap(data, keyed, cut):
    q = np.quantile([r[3] for r in data], cut)
    order = lambda g: [r[2] for r in sorted((r for r in data if r[1] == g), key=lambda r: (r[3], keyed[r[0]]))]
    white, afam = order("white"), order("afam")
    n2, n1 = sum(1 for r in data if r[1] == "white" and r[3] < q), sum(1 for r in data if r[1] == "afam" and r[3] < q)
    for j in range(2, len(data)):
        if n2 - j < 1 or n1 + j > len(afam):
            return None
        if np.mean(afam[:n1 + j]) >= np.mean(white[:n2 - j]):
            return j
    return None


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_calibration_swap_equals_loop(spark, hot):
    data, df = scored(spark, 200, seed=6, hot=hot)
    keyed = {r.id: r.k for r in df.select("id", seeded_key(0, F.col("id")).alias("k")).collect()}
    got = dict(values(measures.calibration_swap(df), "cut", "added"))
    assert got == {c: brute_swap(data, keyed, c) for c in measures.CUTS}


def test_constant_scores_fall_back_to_ranks(spark):
    _, df = scored(spark, 100, hot=1.0)
    assert sorted(values(measures.with_bins(df, 10).groupBy("bin").count(), "bin", "count")) == [(b, 10) for b in range(1, 11)]


def test_normal_tail(spark):
    from math import erfc, sqrt

    zs = [0.0, 0.5, 1.96, -1.96, 4.0, 7.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([erfc(abs(z) / sqrt(2)) for z in zs], rel=2e-7)


def test_nth_smallest_and_threshold(spark):
    data, df = scored(spark, 90, seed=8, hot=0.3)
    n = max(sum(1 - r[2] for r in data), 1)
    assert measures.base_rate_threshold(df).first()[0] == sorted(r[3] for r in data)[n - 1]


def test_bootstrap_interval_covers_the_mean(spark):
    data, df = scored(spark, 400, seed=10)
    r = measures.bootstrap_ci(df, "grp", "y", "id", b=200).where("grp = 'white'").first()
    mean = np.mean([x[2] for x in data if x[1] == "white"])
    se = np.sqrt(mean * (1 - mean) / r.n)
    assert r.low < mean < r.high and (r.high - r.low) == pytest.approx(2 * 1.96 * se, rel=0.35)


def test_folds_are_even_and_downsample_meets_size(spark):
    _, df = scored(spark, 203)
    folds = sampling.stratified_folds(df, "y", "id", 5, 1)
    for part in (0, 1):
        sizes = [r["count"] for r in folds.where(F.col("y") == part).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1
    kept = sampling.downsample(df, "grp", "y", "afam", "id", 1)
    counts = dict(values(kept.groupBy("grp").count(), "grp", "count"))
    assert counts["white"] == min(counts["afam"], 203 - counts["afam"]) or counts["white"] <= counts["afam"]


def test_truncation_sample_meets_quotas(spark):
    rng = random.Random(12)
    att = [(i, c, n) for i in range(120) for c in [i % 2] for n in sorted(rng.sample(range(1, 6), rng.randint(1, 5)))]
    df = spark.createDataFrame(att, "id int, cohort int, nth int")
    quotas = {0: {5: 10, 4: 50, 3: 0, 2: 5, 1: 5}, 1: {5: 3, 4: 3, 3: 3, 2: 3, 1: 3}}
    got = sampling.truncation_sample(df, quotas, "id", "nth", "cohort", 5).collect()
    assert len({r.id for r in got}) == len(got)
    attended = {(i, n) for i, _, n in att}
    assert all((r.id, r.new_nth) in attended for r in got)
    count = lambda c, n: sum(1 for r in got if r.cohort == c and r.new_nth == n)
    assert [count(1, n) for n in range(1, 6)] == [3] * 5
    free4 = {i for i, c, n in att if c == 0 and n == 4} - {r.id for r in got if r.new_nth == 5}
    assert count(0, 5) == 10 and count(0, 4) == min(50, len(free4))


def test_slots_add_up(spark):
    df = spark.createDataFrame([(1, 2124, 2124, 3.0), (1, 2124, 2132, 4.0), (1, 2124, 2143, 5.0)], "id int, first int, strm int, c double")
    r = reshape.term_slots(df, "id", "first", "strm", ["c"]).first().asDict()
    assert r["c_fa1"] == 3.0 and r["c_sp1"] == 4.0 and r["c_su2"] == 5.0 and sum(v for k, v in r.items() if k != "id") == 12.0


def test_low_missing_max(spark):
    df = spark.createDataFrame([(1, None), (1, 0.0), (2, None), (2, 0.5), (3, 0.0)], "k int, x double")
    assert dict(values(aggs.collapse(df, "k", m=aggs.max_low_missing(F.col("x"))), "k", "m")) == {1: None, 2: 0.5, 3: 0.0}


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    with pytest.raises(ValueError):
        assert_unique(df, "k")
    with pytest.raises(ValueError):
        assert_no_nulls(df)
    with pytest.raises(ValueError):
        joins.join(df, df, "k", expect="m:1")


def test_csv_scan_and_sink_round_trip(spark):
    folder = work_folder(spark)
    spark.createDataFrame([("1", "NA"), ("1", "NA"), ("2", "5")], "id string, v string").coalesce(1).write.csv(f"{folder}/f2015.csv", header=True)
    got = scan_csv_dir(spark, f"{folder}/*", pattern=r"f(\d{4})\.csv")
    assert sorted(values(got, "id", "v", "year")) == [("1", "NA", 2015), ("2", "5", 2015)]
    back = sink(got, work_folder(spark))
    assert back.count() == 2 and cut_lineage(back).count() == 2


def test_group_values_on_missing_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    assert dict(values(aggs.with_group_values(df, "g", n=F.count(F.lit(1))), "id", "n")) == {1: 2, 2: 2, 3: 1}


def test_pr_threshold_equals_scan(spark):
    data, df = scored(spark, 120, seed=14)
    best = None
    for t in sorted({r[3] for r in data if r[3] < 0.8}):
        tp = sum(1 for r in data if r[3] >= t and r[2])
        f1 = 2 * tp / (sum(1 for r in data if r[3] >= t) + sum(r[2] for r in data))
        if best is None or f1 > best[1] + 1e-12:
            best = (t, f1)
    got = measures.pr_threshold(df).first()
    assert (got.threshold, got.f1) == (best[0], pytest.approx(best[1]))


@pytest.mark.parametrize("grade", ["", "A", "AB", "SATISFACTORY-PROGRESS"])
def test_fill_grades_of_any_length(spark, grade):
    rows = [(1, 2154, "MTH", "101", "x", 1, 3.0, grade), (1, 2154, "MTH", "101", "x", 2, 3.0, None)]
    df = spark.createDataFrame(rows, "student int, strm int, subject string, course_num string, college string, section int, credit double, grade string")
    got = {r.section: r.grade for r in courses.fill_grades(df).collect()}
    assert got == {1: grade, 2: grade or None}


def test_spells_end_with_the_calendar(spark):
    df = spark.sql("SELECT 1 AS id, date '2005-09-01' AS begin_date, date '9999-12-31' AS end_date")
    assert max(r.strm for r in joins.spells_to_terms(df, (2000, 2006)).collect()) == 2064


def test_downsample_keeps_a_stratum_without_group(spark):
    rows = [(i, "afam", i % 2) for i in range(10)] + [(100 + i, None, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, grp string, y int")
    from cohortlens.operators.sampling import downsample

    got = [r.grp for r in downsample(df, "grp", "y", "afam", "id").collect()]
    assert got.count("afam") == 10 and got.count(None) == 10


def test_pooled_segments_keep_rows_without_training(spark):
    from cohortlens.plans.measures import pooled_segments

    df = spark.createDataFrame([("a", 0.1, 0, 0), ("a", 0.9, 1, 1), ("b", 0.5, 1, 1)], "seg string, score double, y int, valid int")
    got = {r.seg: r.threshold for r in pooled_segments(df, "seg", F.col("valid") == 0).collect()}
    assert got == {"a": 0.1, "b": None}


def test_forests_that_cannot_be_built_raise(spark):

    df = spark.createDataFrame([(0.0, 1.0, 0, 0), (1.0, 0.0, 1, 0)], "a double, b double, y int, valid int")
    with pytest.raises(ValueError):
        models.fit_rf(df, ["a", "b"], models.Forest(31, 2, 2))
    with pytest.raises(ValueError):
        models.fit_rf(df, ["a", "b"], models.Forest(3, 2, 3))
    with pytest.raises(ValueError):
        models.run_variant(df, ["a", "b"], models.Variant({None: models.Forest(3, 2, 2)}, segment="a"))
    assert models.COURSE_VARIANTS["base"].forests[None].within(30).depth == 30


def test_values_of_several_groups_come_from_the_source(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, None, None)], "id int, g string, h string")
    out = aggs.with_values_of_groups(df, ("g", {"n": F.count(F.lit(1))}), (["g", "h"], {"m": F.max("id")}), ("h", {"k": F.sum("id")}))
    assert sorted((r.id, r.n, r.m, r.k) for r in out.collect()) == [(1, 2, 1, 4), (2, 2, 2, 6), (3, 2, 3, 4), (4, 2, 4, 6)]


def test_complete_assembly_rejects_missing_values(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    block = spark.createDataFrame([(1, 5)], "id int, v int")
    assert joins.assemble(base, [block], "id", "inner", complete=True).count() == 1
    with pytest.raises(ValueError, match="missing"):
        joins.assemble(base, [block], "id", complete=True)


def test_forest_setting_within_the_predictors():
    deep = models.Forest(34, 260, 15).within(30, 9)
    assert (deep.depth, deep.trees, deep.features) == (30, 260, 9)
    assert models.Forest(5, 10).within(30, 9).features == "sqrt"
