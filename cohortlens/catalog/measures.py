"""Evaluation and group-difference measures on scored rows."""

from pyspark.sql import functions as F

from cohortlens.catalog.registry import ORACLE, query, with_views
from cohortlens.catalog.sql_parts import THRESHOLD, p_sql, t_sql, versus, z_mean, z_prop
from cohortlens.plans import measures as m
from cohortlens.sources.scan import sink, work_folder

CUTS_SQL = "(" + " UNION ALL ".join(f"SELECT {c}::DOUBLE AS cut" for c in m.CUTS) + ")"


def tested(r):
    s = r.scores
    return m.with_threshold(s.where("valid = 1"), s.where("valid = 0"))


@query("m01_class_weights", """
SELECT y, n, sqrt(max(n) OVER () / n::DOUBLE) AS weight FROM (SELECT y, count(*) AS n FROM scores_v WHERE valid=0 GROUP BY y)
""")
def class_weights(r):
    from cohortlens.plans.models import class_weights

    return class_weights(r.scores.where("valid = 0"), "y")


@query("m04_confusion", f"""
WITH {THRESHOLD} SELECT y AS actual, pred, count(*) AS n FROM tested GROUP BY CUBE (y, pred)
""")
def confusion(r):
    return m.confusion(tested(r))


@query("m04_class_report", f"""
WITH {THRESHOLD}, c AS (SELECT grp, sum(y*pred)::DOUBLE AS tp, sum(y*(1-pred))::DOUBLE AS fn,
  sum((1-y)*(1-pred))::DOUBLE AS tn, sum((1-y)*pred)::DOUBLE AS fp FROM tested GROUP BY grp),
d AS (SELECT grp, tp/nullif(tp+fp,0) AS precision_1, tp/nullif(tp+fn,0) AS recall_1,
  tn/nullif(tn+fn,0) AS precision_0, tn/nullif(tn+fp,0) AS recall_0 FROM c)
SELECT *, 2*precision_1*recall_1/nullif(precision_1+recall_1,0) AS f1_1,
  2*precision_0*recall_0/nullif(precision_0+recall_0,0) AS f1_0 FROM d
""")
def class_report(r):
    return m.class_report(tested(r), "grp")


@query("m04_confusion_by_grade", """
WITH g AS (SELECT grade, (credit*37 + strm*13 + section*7) % 100 / 100::DOUBLE AS score, strm,
  CASE WHEN grade IN ('A','B','C') THEN 1 ELSE 0 END AS y FROM enrolment_v
  WHERE grade IN ('A','B','C','D','F','W')),
thr AS (SELECT score AS t FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn FROM g WHERE strm < 2000)
  WHERE rn = (SELECT greatest(sum(1-y),1) FROM g WHERE strm < 2000))
SELECT grade AS actual, pred, count(*) AS n FROM (SELECT grade,
  CASE WHEN score > (SELECT t FROM thr) THEN 1 ELSE 0 END AS pred FROM g WHERE strm >= 2000) GROUP BY CUBE (grade, pred)
""")
def confusion_by_grade(r):
    from cohortlens.functions.grades import OUTCOME, PASSED_WELL

    g = sink(r.enrolment.where(F.col("grade").isin(OUTCOME)).select(
        "grade", "strm", (((F.col("credit") * 37 + F.col("strm") * 13 + F.col("section") * 7) % 100) / 100).alias("score"),
        F.col("grade").isin(PASSED_WELL).cast("int").alias("y")), work_folder(r.spark))
    return m.confusion(m.with_threshold(g.where("strm >= 2000"), g.where("strm < 2000")), rows="grade")


AUC_SQL = """SELECT {k}sum(CASE WHEN y=1 THEN lo + eq/2.0 ELSE 0 END)::DOUBLE
  / nullif(sum(y)::DOUBLE * sum(1-y), 0) AS auc, count(*) AS n FROM (
  SELECT *, sum(1-y) OVER (PARTITION BY {p} ORDER BY score) - sum(1-y) OVER (PARTITION BY {p}, score) AS lo,
  sum(1-y) OVER (PARTITION BY {p}, score) AS eq FROM {src}) {g}"""


@query("m08_auc", AUC_SQL.format(k="", p="1", src="scores_v", g=""))
def auc(r):
    return m.auc(r.scores)


@query("m08_auc_by_group", AUC_SQL.format(k="valid, grp, ", p="valid, grp", src="scores_v", g="GROUP BY valid, grp"))
def auc_by_group(r):
    return m.auc(r.scores, ["valid", "grp"])


@query("m09_base_rate_threshold", f"WITH {THRESHOLD} SELECT t AS threshold FROM thr")
def base_rate_threshold(r):
    return m.base_rate_threshold(r.scores.where("valid = 0"))


@query("m10_balanced_accuracy", f"""
WITH {THRESHOLD} SELECT grp, (avg(CASE WHEN y=1 THEN pred END) + avg(CASE WHEN y=0 THEN 1-pred END))/2 AS balanced_accuracy
FROM tested GROUP BY grp
""")
def balanced_accuracy(r):
    return m.balanced_accuracy(tested(r), "grp")


RATES = versus("grp, n, actual_rate, pred_rate", {
    "p_actual": lambda f: z_prop(f("n"), f("actual_rate"), "n", "actual_rate"),
    "p_pred": lambda f: z_prop(f("n"), f("pred_rate"), "n", "pred_rate")})


@query("m11_success_rates", f"""
WITH {THRESHOLD}, t AS (SELECT coalesce(grp, 'overall') AS grp, count(*) AS n, avg(y) AS actual_rate, avg(pred) AS pred_rate
FROM tested GROUP BY CUBE (grp)) {RATES}
""")
def success_rates(r):
    return m.success_rates(tested(r))


@query("m11_success_rates_train", f"""
WITH {THRESHOLD.replace("WHERE valid=1", "WHERE valid=0")}, t AS (SELECT coalesce(grp, 'overall') AS grp, count(*) AS n,
avg(y) AS actual_rate, avg(pred) AS pred_rate FROM tested GROUP BY CUBE (grp)) {RATES}
""")
def success_rates_train(r):
    train = r.scores.where("valid = 0")
    return m.success_rates(m.with_threshold(train, train))


@query("m12_tpr_bias", f"""
WITH {THRESHOLD}, t AS (SELECT grp, sum(y)::BIGINT AS n, avg(CASE WHEN y=1 THEN pred END) AS tpr FROM tested GROUP BY grp)
{versus("grp, n, tpr", {"p_value": lambda f: z_prop(f("n"), f("tpr"), "n", "tpr")})}
""")
def tpr_bias(r):
    return m.tpr_bias(tested(r))


@query("m13_fpr_precision0_bias", f"""
WITH {THRESHOLD}, t AS (SELECT grp, sum(1-pred)::BIGINT AS n_below, 1-avg(CASE WHEN pred=0 THEN y END) AS precision_0,
  sum(1-y)::BIGINT AS n_failed, avg(CASE WHEN y=0 THEN pred END) AS fpr FROM tested GROUP BY grp)
{versus("grp, n_below, precision_0, n_failed, fpr", {
    "p_precision_0": lambda f: z_prop(f("n_below"), f("precision_0"), "n_below", "precision_0"),
    "p_fpr": lambda f: z_prop(f("n_failed"), f("fpr"), "n_failed", "fpr")})}
""")
def fpr_precision0_bias(r):
    return m.fpr_precision0_bias(tested(r))


@query("m14_bas_bias", f"""
WITH {THRESHOLD}, t AS (SELECT grp, count(*) AS n,
 (avg(CASE WHEN y=1 THEN pred END) + avg(CASE WHEN y=0 THEN 1-pred END))/2 AS balanced_accuracy FROM tested GROUP BY grp)
{versus("grp, n, balanced_accuracy", {"p_value": lambda f: z_prop(f("n"), f("balanced_accuracy"), "n", "balanced_accuracy")})}
""")
def bas_bias(r):
    return m.bas_bias(tested(r))


@query("m15_score_bias", f"""
WITH t AS (SELECT valid, grp, count(*) AS n, avg(score) - avg(y) AS gap, var_pop(score) AS variance FROM scores_v GROUP BY valid, grp)
{versus("valid, grp, n, gap, variance", {
    "p_value": lambda f: z_mean(f("n"), f("gap"), f("variance"), "n", "gap", "variance")}, by="valid")}
""")
def score_bias(r):
    return m.score_bias(r.scores, "valid")


@query("m16_z_tests", f"""
WITH g AS (SELECT grp, count(*) AS n, avg(y) AS p, avg(score) AS mean, var_pop(score) AS v FROM scores_v GROUP BY grp),
z AS (SELECT b.grp, {z_prop("a.n", "a.p", "b.n", "b.p")} AS z_prop, {z_mean("a.n", "a.mean", "a.v", "b.n", "b.mean", "b.v")} AS z_mean
  FROM g a JOIN g b ON a.grp = 'white' AND b.grp <> 'white')
SELECT *, {p_sql("z_prop")} AS p_prop, {p_sql("z_mean")} AS p_mean FROM z
""")
def z_tests(r):
    from cohortlens.functions.stats import two_sided_p, z_means, z_proportions

    g = r.scores.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p"), F.avg("score").alias("mean"),
                                    F.var_pop("score").alias("v"))
    ref = g.where(F.col("grp") == m.REFERENCE).select(F.struct("n", "p", "mean", "v")).scalar()
    c, a = F.col, lambda k: F.col("ref")[k]
    z = g.where(F.col("grp") != m.REFERENCE).withColumn("ref", ref).select(
        "grp", z_proportions(a("n"), a("p"), c("n"), c("p")).alias("z_prop"),
        z_means(a("n"), a("mean"), a("v"), c("n"), c("mean"), c("v")).alias("z_mean"))
    return z.withColumns({"p_prop": two_sided_p(c("z_prop")), "p_mean": two_sided_p(c("z_mean"))})


def _bins_sql(bins):
    probs = ", ".join(f"{i}/{bins}::DOUBLE" for i in range(1, bins))
    return (f"edges AS (SELECT unnest(quantile_cont(score, [{probs}])) AS e FROM src), "
            f"binned AS (SELECT src.*, 1 + (SELECT count(*) FROM edges WHERE e < src.score) AS bin FROM src)")


def _curve_sql(bins):
    return (f"WITH src AS (SELECT * FROM scores_v WHERE valid=1), {_bins_sql(bins)} "
            f"SELECT grp, bin, count(*) AS n, avg(y) AS rate, ((2*bin-1)*{50.0 / bins}::DOUBLE) AS pct FROM binned GROUP BY grp, bin")


@query("m17_calibration_curve_50", _curve_sql(50))
def calibration_curve_50(r):
    return m.calibration_curve(r.scores.where("valid = 1"), 50)


@query("m17_calibration_curve_10", _curve_sql(10))
def calibration_curve_10(r):
    return m.calibration_curve(r.scores.where("valid = 1"), 10)


@query("m17_calibration_rank_fallback", """
WITH src AS (SELECT grp, y, row_number() OVER (ORDER BY s, md5(concat_ws('#', id, '0')), id)::DOUBLE AS score FROM (
  SELECT *, floor(score*4)/4 AS s FROM scores_v WHERE valid=1)), """ + _bins_sql(10) + """
SELECT grp, bin, count(*) AS n, avg(y) AS rate, ((2*bin-1)*5.0::DOUBLE) AS pct FROM binned GROUP BY grp, bin
""")
def calibration_rank_fallback(r):
    coarse = r.scores.where("valid = 1").withColumn("score", F.floor(F.col("score") * 4) / 4)
    return m.calibration_curve(coarse, 10)


@query("m18_parity_at", f"""
WITH src AS (SELECT * FROM scores_v WHERE valid=1), {_bins_sql(10)},
t AS (SELECT 10*bin-5 AS pct, grp, count(*) AS n, avg(y) AS rate FROM binned WHERE 10*bin-5 IN (15,55,85) GROUP BY bin, grp)
{versus("pct, grp, n, rate", {"p_value": lambda f: z_prop(f("n"), f("rate"), "n", "rate")}, by="pct")}
""")
def parity_at(r):
    return m.parity_at(r.scores.where("valid = 1"))


def _swap_sql(counts, where="valid=1", x="score"):
    return f"""
WITH src AS (SELECT *, {x} AS x FROM scores_v WHERE {where}), cuts AS {CUTS_SQL}, {counts},
sizes AS (SELECT cut, max(CASE WHEN grp='afam' THEN n END) AS n1, max(CASE WHEN grp='afam' THEN p END) AS p1,
  max(CASE WHEN grp='white' THEN n END) AS n2, max(CASE WHEN grp='white' THEN p END) AS p2 FROM counts GROUP BY cut),
ranked AS (SELECT grp, row_number() OVER w AS k, sum(y) OVER w AS cum FROM src WHERE grp IN ('white','afam')
  WINDOW w AS (PARTITION BY grp ORDER BY x, md5(concat_ws('#', id, '0')), id ROWS UNBOUNDED PRECEDING)),
pairs AS (SELECT s.cut, a.k - s.n1 AS j, a.k AS nn1, b.k AS nn2, a.cum/a.k::DOUBLE AS pp1, b.cum/b.k::DOUBLE AS pp2
  FROM sizes s JOIN ranked a ON a.grp='afam' AND a.k - s.n1 >= 2 JOIN ranked b ON b.grp='white' AND b.k = s.n2 - (a.k - s.n1)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY j) AS rn FROM pairs WHERE pp1 >= pp2) WHERE rn = 1)
SELECT s.*, b.j::BIGINT AS added, b.nn1, b.nn2, b.pp1, b.pp2 FROM sizes s LEFT JOIN best b USING (cut)"""


BELOW_Q = """qs AS (SELECT {qs}), q AS ({rows}),
counts AS (SELECT q.cut, grp, sum(CASE WHEN x < q.v THEN 1 ELSE 0 END)::BIGINT AS n, avg(CASE WHEN x < q.v THEN y END) AS p
  FROM src, q WHERE grp IN ('white','afam') GROUP BY q.cut, grp)""".format(
    qs=", ".join(f"(SELECT quantile_cont(x, {c}::DOUBLE) FROM src) AS q{i}" for i, c in enumerate(m.CUTS)),
    rows=" UNION ALL ".join(f"SELECT {c}::DOUBLE AS cut, q{i} AS v FROM qs" for i, c in enumerate(m.CUTS)))
BELOW_RANK = """rk AS (SELECT *, row_number() OVER (ORDER BY x, md5(concat_ws('#', id, '0')), id) AS rnk,
  count(*) OVER () AS size FROM src),
counts AS (SELECT c.cut, grp, sum(CASE WHEN rnk <= floor(size*c.cut) THEN 1 ELSE 0 END)::BIGINT AS n,
  avg(CASE WHEN rnk <= floor(size*c.cut) THEN y END) AS p FROM rk, cuts c WHERE grp IN ('white','afam') GROUP BY c.cut, grp)"""


@query("m19_calibration_swap", _swap_sql(BELOW_Q))
def calibration_swap(r):
    return m.calibration_swap(r.scores.where("valid = 1"))


@query("m20_precision0_tnr", "WITH src AS (SELECT *, score AS x FROM scores_v WHERE valid=1), " + BELOW_Q.split("counts AS")[0] + """
t AS (SELECT grp, cut, sum(CASE WHEN x < v THEN 1 ELSE 0 END) AS n_below, 1-avg(CASE WHEN x < v THEN y END) AS precision_0,
  sum(1-y) AS n_failed, avg(CASE WHEN y=0 THEN CASE WHEN x < v THEN 1 ELSE 0 END END) AS tnr
  FROM src, q WHERE grp IN ('white','afam') GROUP BY grp, cut)
SELECT grp, cut, precision_0, sqrt(precision_0*(1-precision_0)/nullif(n_below,0)) AS se_precision_0, tnr,
  sqrt(tnr*(1-tnr)/nullif(n_failed,0)) AS se_tnr FROM t""")
def precision0_tnr(r):
    return m.precision0_tnr(r.scores.where("valid = 1"))


OLS_SQL = """SELECT {k}regr_count({y},{x})::BIGINT AS n, regr_slope({y},{x}) AS slope, regr_intercept({y},{x}) AS intercept,
  regr_r2({y},{x}) AS r2, regr_slope({y},{x}) / nullif(sqrt((regr_syy({y},{x}) - regr_sxy({y},{x})*regr_sxy({y},{x})/nullif(regr_sxx({y},{x}),0))
  / nullif(regr_count({y},{x})-2,0) / nullif(regr_sxx({y},{x}),0)),0) AS t FROM {src} {g}"""


@query("m21_ols_by_group", f"SELECT *, {t_sql('t', '(n-2)')} AS p_value FROM (" + OLS_SQL.format(
    k="grp, ", y="y", x="score", src="scores_v", g="GROUP BY grp") + ")")
def ols_by_group(r):
    return m.ols1(r.scores, "score", "y", "grp")


@query("m22_efron_r2", """
WITH a AS (SELECT *, avg(y) OVER (PARTITION BY grp) AS ybar FROM scores_v WHERE valid=0)
SELECT grp, 1 - sum((y-score)*(y-score)) / nullif(sum((y-ybar)*(y-ybar)),0) AS efron_r2 FROM a GROUP BY grp
""")
def efron_r2(r):
    return m.efron_r2(r.scores.where("valid = 0"))


@query("m23_mcfadden", """
WITH a AS (SELECT grp, y, least(greatest(score, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, avg(y) OVER (PARTITION BY grp) AS ybar
  FROM scores_v WHERE valid=0)
SELECT grp, 1 - (sum(ln(CASE WHEN y=1 THEN p ELSE 1-p END)) - 294) / sum(ln(CASE WHEN y=1 THEN ybar ELSE 1-ybar END)) AS mcfadden_r2
FROM a GROUP BY grp
""")
def mcfadden(r):
    return m.mcfadden(r.scores.where("valid = 0"), 294)


GAP_COLS = ["balance", "distance", "total_credit_hrs", "fhe", "mhe"]


def gap_frame(r):
    return r.snapshots.join(r.students, "student").select("grp", *GAP_COLS)


@query("m24_predictor_gap", """
WITH f AS (SELECT v.grp, v.balance, s.distance, s.total_credit_hrs, s.fhe, s.mhe FROM snapshot_v s JOIN student_v v USING (student)),
long AS (""" + " UNION ALL ".join(f"SELECT grp, '{c}' AS predictor, {c}::DOUBLE AS v FROM f" for c in GAP_COLS) + """),
g AS (SELECT predictor, grp, count(v) AS n, avg(v) AS mu, var_samp(v) AS va, count(*) AS k,
  avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS q, var_samp(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS w
  FROM long WHERE grp IN ('white','afam') GROUP BY predictor, grp),
z AS (SELECT a.predictor, a.mu AS reference_mean, b.mu - a.mu AS gap, a.q AS reference_missing, b.q - a.q AS gap_missing,
  (b.mu-a.mu)/nullif(sqrt(a.va/a.n + b.va/b.n),0) AS z1, (b.q-a.q)/nullif(sqrt(a.w/a.k + b.w/b.k),0) AS z2
  FROM g a JOIN g b ON a.predictor=b.predictor AND a.grp='white' AND b.grp='afam')
SELECT predictor, reference_mean, gap, """ + p_sql("z1") + " AS p_value, reference_missing, gap_missing, " + p_sql("z2") + """ AS p_missing FROM z
""")
def predictor_gap(r):
    return m.predictor_gap(gap_frame(r), GAP_COLS)


def _coarse_model(df):
    """A second score column over the same rows, standing for a segment model."""
    return df.withColumn("score", F.floor(F.col("score") * 100) / 100)


@query("m26_calibration_summary", f"""
WITH base AS ({_swap_sql(BELOW_Q)}), seg AS ({_swap_sql(BELOW_Q, x="floor(score*100)/100")})
SELECT cut, CASE WHEN base.added=2 THEN 0 ELSE base.added END / base.n1::DOUBLE AS share_base,
 CASE WHEN seg.added=2 THEN 0 ELSE seg.added END / seg.n1::DOUBLE AS share_segment FROM base JOIN seg USING (cut)
""")
def calibration_summary(r):
    test = r.scores.where("valid = 1")
    return m.calibration_summary(m.calibration_swap(_coarse_model(test)), m.calibration_swap(test))


@query("m27_rank_cut", """
WITH b AS (SELECT q.id, q.grp, q.y, v.balance FROM scores_v q JOIN orders o ON q.id=o.o_orderkey JOIN student_v v ON v.student=o.o_custkey),
rk AS (SELECT *, row_number() OVER (ORDER BY balance, md5(concat_ws('#', id, '0')), id) AS rnk, count(*) OVER () AS size FROM b)
SELECT grp, count(*) AS n, avg(y) AS rate, max(rnk)::BIGINT AS last_rank FROM rk WHERE rnk <= floor(size*0.33::DOUBLE) GROUP BY grp
""")
def rank_cut(r):
    scored = r.scores.join(r.orders, F.col("id") == F.col("o_orderkey")).join(
        r.students.select("student", "balance"), F.col("o_custkey") == F.col("student")).select("id", "grp", "y", "balance")
    cut = m.rank_cut(m.rank_score(scored, "balance", "id"), 0.33)
    return cut.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.max("rank").alias("last_rank"))


@query("m27_rank_swap", _swap_sql(BELOW_RANK))
def rank_swap(r):
    return m.calibration_swap(r.scores.where("valid = 1"), exact_size=True)


STEPS = " + ".join(f"CASE WHEN u >= {s} THEN 1 ELSE 0 END" for s in m.POISSON_STEPS)


@query("m28_bootstrap_ci", f"""
WITH src AS (SELECT * FROM scores_v WHERE valid=1), {_bins_sql(10)},
d AS (SELECT grp, bin, y, k.pack, md5(concat_ws('#', id, '0', k.pack)) AS h FROM binned, (SELECT unnest(range(0,125)) AS pack) k),
u AS (SELECT grp, bin, y, pack*8+s.s AS r, CAST('0x' || substr(h, 4*s.s+1, 4) AS INTEGER) AS u FROM d, (SELECT unnest(range(0,8)) AS s) s),
w AS (SELECT grp, bin, r, sum(w) AS sw, sum(w*y) AS sx FROM (SELECT grp, bin, r, y, {STEPS} AS w FROM u) GROUP BY grp, bin, r),
ci AS (SELECT grp, bin, quantile_cont(sx::DOUBLE/nullif(sw,0), 0.025::DOUBLE) AS low, quantile_cont(sx::DOUBLE/nullif(sw,0), 0.975::DOUBLE) AS high
  FROM w GROUP BY grp, bin)
SELECT grp, bin, n, mean, low, high FROM (SELECT grp, bin, count(*) AS n, avg(y) AS mean FROM binned GROUP BY grp, bin) JOIN ci USING (grp, bin)
""")
def bootstrap_ci(r):
    return m.bootstrap_ci(m.with_bins(r.scores.where("valid = 1"), 10), ["grp", "bin"], "y", "id")


@query("m29_pooled_segments", """
WITH l AS (SELECT grp, score AS threshold FROM (SELECT grp, score, row_number() OVER (PARTITION BY grp ORDER BY score) AS rn,
  greatest(sum(1-y) OVER (PARTITION BY grp),1) AS need FROM scores_v WHERE valid=0) WHERE rn=need)
SELECT grp, max(threshold) AS threshold, count(*) AS n, avg(CASE WHEN score > threshold THEN 1 ELSE 0 END) AS pred_rate,
 (avg(CASE WHEN y=1 THEN CASE WHEN score>threshold THEN 1 ELSE 0 END END)+avg(CASE WHEN y=0 THEN CASE WHEN score>threshold THEN 0 ELSE 1 END END))/2 AS balanced_accuracy
FROM scores_v JOIN l USING (grp) WHERE valid=1 GROUP BY grp
""")
def pooled_segments(r):
    pooled = m.pooled_segments(r.scores, "grp", F.col("valid") == 0)
    tpr, tnr = m.mean_if(m.predicted(), F.col("y") == 1), m.mean_if(1 - m.predicted(), F.col("y") == 0)
    return pooled.groupBy("grp").agg(F.max("threshold").alias("threshold"), F.count(F.lit(1)).alias("n"),
                                     F.avg(m.predicted()).alias("pred_rate"), m.balanced(tpr, tnr).alias("balanced_accuracy"))


PR_SQL = """c AS (SELECT fold, score, n, pos, sum(n) OVER (PARTITION BY fold ORDER BY score DESC) AS called,
  sum(pos) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY fold) AS p FROM (
  SELECT fold, score, count(*) AS n, sum(y) AS pos FROM f GROUP BY fold, score)),
best AS (SELECT fold, score AS threshold, f1 FROM (SELECT *, 2*tp/nullif(called+p,0)::DOUBLE AS f1,
  row_number() OVER (PARTITION BY fold ORDER BY 2*tp/nullif(called+p,0)::DOUBLE DESC NULLS LAST, score) AS rn FROM c WHERE score < 0.8::DOUBLE) WHERE rn=1)"""


@query("m30_pr_threshold", f"""
WITH f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('#', id, '7')), id) - 1) % 10 AS fold FROM scores_v WHERE valid=0),
{PR_SQL} SELECT fold, threshold, f1 FROM best
""")
def pr_threshold(r):
    from cohortlens.operators.sampling import stratified_folds

    return m.pr_threshold(stratified_folds(r.scores.where("valid = 0"), "y", "id", 10, 7), "fold")


@query("m30_pr_threshold_geometric_mean", f"""
WITH f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('#', id, '7')), id) - 1) % 10 AS fold FROM scores_v WHERE valid=0),
{PR_SQL} SELECT exp(avg(ln(threshold))) AS threshold, count(*) AS folds FROM best
""")
def pr_threshold_geometric_mean(r):
    from cohortlens.operators.sampling import stratified_folds

    best = m.pr_threshold(stratified_folds(r.scores.where("valid = 0"), "y", "id", 10, 7), "fold")
    return best.agg(m.geometric_mean("threshold").alias("threshold"), F.count(F.lit(1)).alias("folds"))


@query("m07_compare_importance", """
WITH f AS (SELECT q.y, v.grp, v.balance, s.distance, s.total_credit_hrs::DOUBLE AS total_credit_hrs, s.fhe, s.mhe FROM scores_v q JOIN snapshot_v s ON s.source=q.id JOIN student_v v ON v.student=s.student),
long AS (""" + " UNION ALL ".join(f"SELECT grp, y, '{c}' AS predictor, {c}::DOUBLE AS v FROM f" for c in GAP_COLS) + """),
i AS (SELECT predictor, abs(corr(y, v) FILTER (WHERE grp='white')) AS a, abs(corr(y, v) FILTER (WHERE grp='afam')) AS b FROM long GROUP BY predictor),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1)/2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1)/2.0 AS rb FROM i)
SELECT count(*) AS n, sqrt(sum((a-b)*(a-b))) AS l2, (sqrt(sum((ra-rb)*(ra-rb)))/count(*))::DOUBLE AS l2_rank FROM k
""")
def compare_importance(r):
    """Predictor importance per group, here the absolute correlation with the outcome, compared between groups."""
    f = r.scores.join(r.snapshots, F.col("id") == F.col("source")).join(r.students.drop("grp"), "student")

    def importance(group):
        row = f.where(F.col("grp") == group).agg(*[F.abs(F.corr(F.col("y").cast("double"), F.col(c).cast("double"))).alias(c) for c in GAP_COLS])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(c).alias("importance")) for c in GAP_COLS])).alias("r")).select("r.*")

    return m.compare_importance(importance("white"), importance("afam"))


def _long_sql(name: str, values: dict, grp: str = "grp", at: str = "NULL::DOUBLE", where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS measure, {grp} AS grp, ({at})::DOUBLE AS at, {c}::DOUBLE AS value FROM ({ORACLE[name]}) WHERE {where}" for k, c in values.items())


@query("m_ledger_report", " UNION ALL ".join([
    _long_sql("m08_auc_by_group", {"auc": "auc", "n": "n"}, where="valid=1"),
    "SELECT 'auc', 'overall', NULL::DOUBLE, auc FROM (" + with_views(AUC_SQL.format(k="", p="1", src="scores_v WHERE valid=1", g="")) + ")",
    _long_sql("m09_base_rate_threshold", {"threshold": "threshold"}, "'overall'"),
    _long_sql("m11_success_rates", {k: k for k in ("actual_rate", "pred_rate", "p_actual", "p_pred")}),
    _long_sql("m12_tpr_bias", {"tpr": "tpr", "p_tpr": "p_value"}),
    _long_sql("m13_fpr_precision0_bias", {k: k for k in ("precision_0", "fpr", "p_precision_0", "p_fpr")}),
    _long_sql("m14_bas_bias", {"balanced_accuracy": "balanced_accuracy", "p_balanced_accuracy": "p_value"}),
    _long_sql("m15_score_bias", {"score_gap": "gap", "p_score_gap": "p_value"}, where="valid=1"),
    _long_sql("m17_calibration_curve_10", {"calibration": "rate"}, at="pct"),
    _long_sql("m20_precision0_tnr", {"precision_0_below": "precision_0", "tnr_below": "tnr"}, at="cut"),
    " UNION ALL ".join(f"SELECT '{k}', 'overall', NULL::DOUBLE, {c} FROM (" + with_views(f"WITH f AS (SELECT *, 0 AS fold FROM scores_v WHERE valid=0), {PR_SQL} SELECT threshold, f1 FROM best") + ")"
                       for k, c in (("pr_threshold", "threshold"), ("pr_f1", "f1")))]))
def ledger_report(r):
    """All group measures of a model from one scan of its scores."""
    from cohortlens.plans import ledger as l
    from cohortlens.sources.scan import work_folder

    table = l.ledger(r.scores, ["valid", "grp"], work_folder(r.spark))
    return l.report(table, F.col("valid") == 0, F.col("valid") == 1)
