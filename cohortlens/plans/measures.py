"""Evaluation of scored rows (id, grp, y, score) overall and by group.

Every measure is an aggregate or an order statistic over distinct scores, so no group of rows is ever
sorted in one task. Only cut points and thresholds (a handful of numbers) reach the driver.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.nulls import ratio
from cohortlens.functions.special import poisson_quantile, t_two_sided_p, uniform
from cohortlens.functions.stats import p_means, p_proportions, two_sided_p
from cohortlens.operators.aggs import _cols
from cohortlens.operators.ranking import cumulate, ordinal_rank, quantiles
from cohortlens.plans.swap import first_crossings
from cohortlens.sources.scan import sink, work_folder
from cohortlens.sources.shuffles import partitions

# Quantile cuts of the bias tables.
CUTS = [0.1, 0.2, 0.25, 0.3, 0.33, 0.4, 0.5, 0.6, 0.67, 0.7, 0.75, 0.8, 0.9]
REFERENCE, TARGET = "white", "afam"
MARKED_DECILES = [15, 55, 85]


def mean_if(x, cond: Column) -> Column:
    return F.avg(F.when(cond, x))


def edge_values(df: DataFrame, x: str, probs) -> list[float]:
    rows = quantiles(df, [], x, probs).collect()
    return [r["q"] for r in sorted(rows, key=lambda r: r["prob"])]


def base_rate_threshold(train: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Score that as many training rows reach or stay below as there are failures (at least one row)."""
    c = cumulate(train, [], score, {"positives": y})
    failures = train.agg(F.greatest(F.count_if(F.col(y) == 0), F.lit(1))).scalar()
    return c.where(F.col("cum_n") >= failures).agg(F.min(score).alias("threshold"))


def with_threshold(df: DataFrame, train: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("threshold", base_rate_threshold(train, score).scalar())


def predicted(score: str = "score") -> Column:
    return (F.col(score) > F.col("threshold")).cast("int")


def auc(df: DataFrame, by=(), score: str = "score", y: str = "y") -> DataFrame:
    """Exact area under the ROC curve; ties count half, a single-class group has none."""
    by = _cols(by)
    c = cumulate(df, by, score, {"positives": y})
    neg = F.col("n") - F.col("positives")
    neg_below = (F.col("cum_n") - F.col("cum_positives")) - neg
    wins = F.sum(F.col("positives") * (neg_below + neg / 2))
    return c.groupBy(*by).agg(ratio(wins, F.sum("positives") * F.sum(neg)).alias("auc"),
                              F.sum("n").alias("n"))


def confusion(df: DataFrame, y: str = "y", rows: str | None = None) -> DataFrame:
    """Counts of actual x predicted with margins (NULL label = margin); ``df`` holds a threshold column."""
    actual = rows or y
    return df.withColumn("pred", predicted()).cube(F.col(actual).alias("actual"), "pred").agg(
        F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, by=()) -> DataFrame:
    """Precision, recall and F1 of both classes."""
    y, p = F.col("y"), predicted()
    n = lambda a, b: F.count_if((y == a) & (p == b))
    out = df.groupBy(*_cols(by)).agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"), n(0, 1).alias("fp"))
    p1, r1 = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    p0, r0 = ratio(F.col("tn"), F.col("tn") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return out.select(*_cols(by), p1.alias("precision_1"), r1.alias("recall_1"), ratio(2 * p1 * r1, p1 + r1).alias("f1_1"),
                      p0.alias("precision_0"), r0.alias("recall_0"), ratio(2 * p0 * r0, p0 + r0).alias("f1_0"))


def balanced(tpr: Column, tnr: Column) -> Column:
    """Mean recall over the classes that occur."""
    return F.coalesce((tpr + tnr) / 2, tpr, tnr)


def balanced_accuracy(df: DataFrame, by=()) -> DataFrame:
    tpr, tnr = mean_if(predicted(), F.col("y") == 1), mean_if(1 - predicted(), F.col("y") == 0)
    return df.groupBy(*_cols(by)).agg(balanced(tpr, tnr).alias("balanced_accuracy"))


def against_reference(table: DataFrame, p_values: dict, group: str = "grp", reference: str = REFERENCE,
                      by=()) -> DataFrame:
    """Add p-value columns comparing each row of a small group table with its reference row.

    ``p_values``: name -> (kind, n column, value column[, variance column]).
    """
    whole = Window.partitionBy(*(_cols(by) or [F.lit(1)]))
    ref = lambda c: F.max(F.when(F.col(group) == reference, F.col(c))).over(whole)
    other = F.col(group) != reference
    out = {}
    for name, spec in p_values.items():
        if spec[0] == "proportion":
            p = p_proportions(ref(spec[1]), ref(spec[2]), F.col(spec[1]), F.col(spec[2]))
        else:
            p = p_means(*[ref(c) for c in spec[1:]], *[F.col(c) for c in spec[1:]])
        out[name] = F.when(other, p)
    return table.select("*", *[c.alias(n) for n, c in out.items()])


def success_rates(df: DataFrame) -> DataFrame:
    """N, actual and predicted success rate, overall and by group, tested against the reference group."""
    agg = [F.count(F.lit(1)).alias("n"), F.avg("y").alias("actual_rate"), F.avg(predicted()).alias("pred_rate")]
    table = df.cube("grp").agg(F.grouping("grp").alias("__all"), *agg).withColumn(
        "grp", F.when(F.col("__all") == 1, "overall").otherwise(F.col("grp"))).drop("__all")
    tested = against_reference(table, {"p_actual": ("proportion", "n", "actual_rate"),
                                       "p_pred": ("proportion", "n", "pred_rate")})
    overall = F.col("grp") == "overall"
    return tested.withColumns({c: F.when(~overall, F.col(c)) for c in ("p_actual", "p_pred")})


def tpr_bias(df: DataFrame) -> DataFrame:
    table = df.groupBy("grp").agg(F.count_if(F.col("y") == 1).alias("n"),
                                  mean_if(predicted(), F.col("y") == 1).alias("tpr"))
    return against_reference(table, {"p_value": ("proportion", "n", "tpr")})


def fpr_precision0_bias(df: DataFrame) -> DataFrame:
    below, y = F.col("score") <= F.col("threshold"), F.col("y")
    table = df.groupBy("grp").agg(
        F.count_if(below).alias("n_below"), (1 - mean_if(y, below)).alias("precision_0"),
        F.count_if(y == 0).alias("n_failed"), mean_if(predicted(), y == 0).alias("fpr"))
    return against_reference(table, {"p_precision_0": ("proportion", "n_below", "precision_0"),
                                     "p_fpr": ("proportion", "n_failed", "fpr")})


def bas_bias(df: DataFrame) -> DataFrame:
    tpr, tnr = mean_if(predicted(), F.col("y") == 1), mean_if(1 - predicted(), F.col("y") == 0)
    table = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), balanced(tpr, tnr).alias("balanced_accuracy"))
    return against_reference(table, {"p_value": ("proportion", "n", "balanced_accuracy")})


def score_bias(df: DataFrame, by=()) -> DataFrame:
    """Mean score minus actual rate; the test uses the population variance of the scores."""
    by = _cols(by)
    table = df.groupBy(*by, "grp").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("score") - F.avg("y")).alias("gap"), F.var_pop("score").alias("variance"))
    return against_reference(table, {"p_value": ("mean", "n", "gap", "variance")}, by=by)


def bin_of(x: Column, edges) -> Column:
    """1-based right-closed bin; the first bin is closed on both sides."""
    b = F.lit(1)
    for e in edges:
        b = b + (x > F.lit(e)).cast("int")
    return b


def with_bins(df: DataFrame, bins: int, x: str = "score", ids="id", out: str = "bin", seed=0) -> DataFrame:
    """Quantile bins; when edges repeat, bins of the ordinal rank instead."""
    probs = [i / bins for i in range(1, bins)]
    edges = edge_values(df, x, probs)
    if len(set(edges)) == len(edges):
        return df.withColumn(out, bin_of(F.col(x), edges))
    ranked = ordinal_rank(df, [], x, ids, seed, "__rank")
    return ranked.withColumn(out, bin_of(F.col("__rank"), edge_values(ranked, "__rank", probs))).drop("__rank")


def calibration_curve(df: DataFrame, bins: int = 50, x: str = "score") -> DataFrame:
    """Actual success rate by group and score bin; ``pct`` is the bin's mid percentile."""
    table = with_bins(df, bins, x).groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return table.withColumn("pct", ((2 * F.col("bin") - 1) * (50.0 / bins)).cast("double"))


def parity_at(df: DataFrame, deciles=MARKED_DECILES) -> DataFrame:
    """Calibration at marked score deciles with a test against the reference group."""
    table = with_bins(df, 10).withColumn("pct", 10 * F.col("bin") - 5).where(F.col("pct").isin(list(deciles)))
    table = table.groupBy("pct", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return against_reference(table, {"p_value": ("proportion", "n", "rate")}, by="pct")


def _cut_counts(df: DataFrame, x: str, cuts, edges) -> DataFrame:
    """Rows (cut, grp, n, p): size and success rate of each group below each cut, in one pass."""
    aggs = []
    for i, e in enumerate(edges):
        below = F.col(x) < F.lit(e)
        aggs.append(F.struct(F.lit(cuts[i]).alias("cut"), F.count_if(below).alias("n"),
                             mean_if(F.col("y"), below).alias("p")))
    grouped = df.groupBy("grp").agg(F.array(*aggs).alias("__a"))
    return grouped.select("grp", F.explode("__a").alias("__r")).select("grp", "__r.*")


def calibration_swap(df: DataFrame, cuts=CUTS, x: str = "score", ids="id", seed=0, reference: str = REFERENCE,
                     target: str = TARGET, exact_size: bool = False) -> DataFrame:
    """How many lowest-ranked reference rows must give way to target rows for equal success rates.

    Below each cut the reference group has n2 rows and the target group n1. The answer is the smallest
    j >= 2 for which the first n1 + j target rows succeed at least as often as the first n2 - j
    reference rows. Running totals in rank order, stored once, make both rates a look-up, and only ranges of ranks in
    which the rates can cross are looked at (see ``plans.swap``). One row for each cut reaches the driver.
    """
    pair = df.where(F.col("grp").isin(reference, target))
    if exact_size:
        ranked_all = rank_score(df, x, ids, seed)
        counts = _rank_counts(ranked_all, cuts, (reference, target))
    else:
        counts = _cut_counts(pair, x, cuts, edge_values(df, x, cuts))
    one = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    sizes = counts.groupBy("cut").agg(one(target, "n").alias("n1"), one(target, "p").alias("p1"),
                                      one(reference, "n").alias("n2"), one(reference, "p").alias("p2")).collect()
    ranked = ordinal_rank(pair, ["grp"], x, ids, seed, "k", {"y": "y"}).select("grp", "k", "cum_y")
    ranked = sink(ranked, work_folder(df.sparkSession))
    best = first_crossings(ranked, [(r["n1"], r["n2"]) for r in sizes], reference, target)
    rows = [(*r, *(found or [None] * 5)) for r, found in zip(sizes, best)]
    return df.sparkSession.createDataFrame(
        rows, "cut double, n1 bigint, p1 double, n2 bigint, p2 double, added bigint, nn1 bigint, nn2 bigint, pp1 double, pp2 double")


def precision0_tnr(df: DataFrame, cuts=CUTS, x: str = "score", groups=(REFERENCE, TARGET)) -> DataFrame:
    """Precision of the failing class and true-negative rate below each cut, with standard errors."""
    edges = edge_values(df, x, cuts)
    aggs = []
    for cut, e in zip(cuts, edges):
        below, failed = F.col(x) < F.lit(e), F.col("y") == 0
        aggs.append(F.struct(
            F.lit(cut).alias("cut"), F.count_if(below).alias("n_below"), (1 - mean_if(F.col("y"), below)).alias("precision_0"),
            F.count_if(failed).alias("n_failed"), mean_if(below.cast("int"), failed).alias("tnr")))
    rows = df.where(F.col("grp").isin(list(groups))).groupBy("grp").agg(F.array(*aggs).alias("__a")).select(
        "grp", F.explode("__a").alias("__r")).select("grp", "__r.*")
    se = lambda p, n: F.sqrt(ratio(F.col(p) * (1 - F.col(p)), F.col(n)))
    return rows.select("grp", "cut", "precision_0", se("precision_0", "n_below").alias("se_precision_0"),
                       "tnr", se("tnr", "n_failed").alias("se_tnr"))


def calibration_summary(segment: DataFrame, base: DataFrame) -> DataFrame:
    """Share of added target rows under two models; the smallest possible answer of 2 means none."""
    part = lambda t, name: t.select("cut", ratio(F.when(F.col("added") == 2, 0).otherwise(F.col("added")), F.col("n1"))
                                    .alias(name))
    return part(base, "share_base").join(part(segment, "share_segment"), "cut")


def rank_score(df: DataFrame, x: str, ids, seed=0, out: str = "rank") -> DataFrame:
    """Single-predictor score: ordinal rank of the predictor."""
    return ordinal_rank(df, [], x, ids, seed, out)


def rank_cut(ranked: DataFrame, q: float, rank: str = "rank") -> DataFrame:
    """Exactly ``int(N q)`` lowest-ranked rows."""
    size = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.where(F.col(rank) <= F.floor(size * F.lit(q)))


def _rank_counts(ranked: DataFrame, cuts, groups, rank: str = "rank") -> DataFrame:
    size = ranked.agg(F.count(F.lit(1))).scalar()
    sized = ranked.withColumn("__size", size)
    aggs = []
    for cut in cuts:
        below = F.col(rank) <= F.floor(F.col("__size") * F.lit(cut))
        aggs.append(F.struct(F.lit(cut).alias("cut"), F.count_if(below).alias("n"), mean_if(F.col("y"), below).alias("p")))
    grouped = sized.where(F.col("grp").isin(list(groups))).groupBy("grp").agg(F.array(*aggs).alias("__a"))
    return grouped.select("grp", F.explode("__a").alias("__r")).select("grp", "__r.*")


def efron_r2(df: DataFrame, by=("grp",), score: str = "score") -> DataFrame:
    y, p = F.col("y"), F.col(score)
    n = F.count(F.lit(1))
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return df.groupBy(*_cols(by)).agg((1 - ratio(F.sum((y - p) * (y - p)), spread)).alias("efron_r2"))


def mcfadden(df: DataFrame, k: int, by=("grp",), score: str = "score", margin: float = 1e-6) -> DataFrame:
    """Adjusted McFadden R²; scores are kept off 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(margin)), F.lit(1 - margin))
    loglik = F.sum(F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))
    n, s = F.count(F.lit(1)).cast("double"), F.sum("y").cast("double")
    null = F.when((s > 0) & (s < n), s * F.log(s / n) + (n - s) * F.log((n - s) / n))
    return df.groupBy(*_cols(by)).agg((1 - ratio(loglik - F.lit(k), null)).alias("mcfadden_r2"))


def predictor_gap(df: DataFrame, cols, groups=(REFERENCE, TARGET)) -> DataFrame:
    """Difference of predictor means, and of missing rates, between two groups with unequal-variance tests.

    One aggregate by group has count, mean and variance of every predictor; predictors become rows behind it.
    """
    per = []
    for c in cols:
        v = F.col(c).cast("double")
        per.append(F.struct(F.lit(c).alias("predictor"), F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v")))
    table = df.where(F.col("grp").isin(list(groups))).groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.array(*per).alias("__a"))
    rows = table.select("grp", "k", F.explode("__a").alias("__r")).select("grp", "k", "__r.*")
    # Missing or not is 0 or 1, so its variance follows from the share.
    share = ratio(F.col("k") - F.col("n"), F.col("k"))
    rows = rows.withColumn("q", share).withColumn("w", ratio(F.col("q") * (1 - F.col("q")) * F.col("k"), F.col("k") - 1))
    first, second = groups
    stats = [F.max(F.when(F.col("grp") == g, F.col(c))).alias(f"{c}_{g}") for g in groups for c in ("n", "m", "v", "k", "q", "w")]
    t = rows.groupBy("predictor").agg(*stats)
    z = lambda n, m, v: ratio(F.col(f"{m}_{second}") - F.col(f"{m}_{first}"), F.sqrt(
        ratio(F.col(f"{v}_{first}"), F.col(f"{n}_{first}")) + ratio(F.col(f"{v}_{second}"), F.col(f"{n}_{second}"))))
    return t.select(
        "predictor", F.col(f"m_{first}").alias("reference_mean"),
        (F.col(f"m_{second}") - F.col(f"m_{first}")).alias("gap"), two_sided_p(z("n", "m", "v")).alias("p_value"),
        F.col(f"q_{first}").alias("reference_missing"),
        (F.col(f"q_{second}") - F.col(f"q_{first}")).alias("gap_missing"), two_sided_p(z("k", "q", "w")).alias("p_missing"))


def ols1(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """One-variable least squares with Student's t test of the slope; two rows or fewer have none."""
    n = F.regr_count(y, x)
    sse = F.regr_syy(y, x) - ratio(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x))
    se = F.sqrt(ratio(sse, (n - 2)) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)))
    t = ratio(F.regr_slope(y, x), se)
    return df.groupBy(*_cols(by)).agg(
        n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), t.alias("t"), n.alias("__n")).withColumn(
        "p_value", t_two_sided_p(F.col("t"), F.col("__n") - 2)).drop("__n")


# Cumulative Poisson(1) probabilities in units of 2^-16.
POISSON_STEPS = [24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]


def bootstrap_ci(df: DataFrame, by, x: str, ids=None, b: int = 1000, seed=0, level: float = 0.95) -> DataFrame:
    """Poisson bootstrap interval of a group mean: of every row by itself with ``ids``, else drawn from the counts of the group's values."""
    by = _cols(by)
    means = _means_of_counts(df, by, x, b, seed) if ids is None else _means_of_rows(df, by, x, _cols(ids), b, seed)
    tail = (1 - level) / 2
    ci = means.groupBy(*by).agg(F.percentile("__m", F.lit([tail, 1 - tail])).alias("__ci"))
    point = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))
    return point.join(ci, by).select(*by, "n", "mean", F.col("__ci")[0].alias("low"), F.col("__ci")[1].alias("high"))


def _means_of_rows(df: DataFrame, by: list, x: str, ids: list, b: int, seed) -> DataFrame:
    """Group means of each replicate, every row with a weight of its own.

    A row's weight in replicate r comes from 16 bits of a seeded digest, so one digest serves eight replicates. Replicates are
    added up next to the data before any shuffle; what moves is one partial sum per group and pack of replicates.
    """
    packs = F.explode(F.sequence(F.lit(0), F.lit((b + 7) // 8 - 1))).alias("__pack")
    digest = F.md5(F.concat_ws("#", *[F.col(i).cast("string") for i in ids], F.lit(str(seed)), F.col("__pack").cast("string")))
    # A row becomes many: dealt by a fixed number, since adaptive execution would join these partitions for their few bytes.
    rows = df.where(F.col(x).isNotNull()).repartition(partitions(df.sparkSession), *ids)
    draws = rows.select(*by, x, *[i for i in ids if i not in [*by, x]], packs).withColumn("__d", digest)

    def weight(slot):
        u = F.conv(F.substring(F.col("__d"), 4 * slot + 1, 4), 16, 10).cast("int")
        return sum(((u >= step).cast("int") for step in POISSON_STEPS), F.lit(0))

    sums = []
    for s in range(8):
        sums += [F.sum(weight(s)).alias(f"__w{s}"), F.sum(weight(s) * F.col(x)).alias(f"__x{s}")]
    totals = draws.groupBy(*by, "__pack").agg(*sums)
    replicates = F.explode(F.array(*[
        F.struct((F.col("__pack") * 8 + s).alias("r"), ratio(F.col(f"__x{s}"), F.col(f"__w{s}")).alias("m")) for s in range(8)])).alias("__of")
    return totals.select(*by, replicates).where(F.col("__of.r") < b).select(*by, F.col("__of.m").alias("__m"))


def _means_of_counts(df: DataFrame, by: list, x: str, b: int, seed) -> DataFrame:
    """Group means of each replicate, rows that agree in group and value drawn together.

    Rows of one group and value have independent Poisson weights of mean 1 in a replicate, so their sum is one Poisson draw whose
    mean is their count. A replicate costs a draw for each value, whatever the number of rows; draws are quantiles of a seeded
    digest of group, value and replicate.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__n"))
    draws = values.select(*by, x, "__n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("__r"))
    weight = poisson_quantile(uniform(*[F.col(c) for c in by], F.col(x), F.lit(str(seed)), F.col("__r")), F.col("__n"))
    return draws.withColumn("__w", weight).groupBy(*by, "__r").agg(ratio(F.sum(F.col("__w") * F.col(x)), F.sum("__w")).alias("__m"))


def pr_threshold(df: DataFrame, by=(), score: str = "score", y: str = "y", cap: float = 0.8) -> DataFrame:
    """Score below ``cap`` with the highest F1 of "score at least t" (lowest such score on a tie)."""
    by = _cols(by)
    c = cumulate(df, by, score, {"positives": y})
    totals = df.groupBy(*by).agg(F.count(score).alias("__n"), F.sum(F.when(F.col(score).isNotNull(), F.col(y))).alias("__p"))
    if by:
        c = c.join(totals, by)
    else:
        c = c.withColumn("__t", totals.select(F.struct("__n", "__p")).scalar()).select("*", "__t.*")
    tp = F.col("__p") - (F.col("cum_positives") - F.col("positives"))
    called = F.col("__n") - (F.col("cum_n") - F.col("n"))
    f1 = ratio(2 * tp, called + F.col("__p"))
    scored = c.where(F.col(score) < cap).withColumn("__f1", f1).where("__f1 is not null")
    return scored.groupBy(*by).agg(F.min_by(score, F.struct(-F.col("__f1"), F.col(score))).alias("threshold"),
                                   F.max("__f1").alias("f1"))


def geometric_mean(x) -> Column:
    return F.when(F.min(x) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(x))))


def score_profile(df: DataFrame, by="grp", x: str = "score", bins: int = 25) -> DataFrame:
    """Histogram density of a score in [0, 1] by group."""
    b = F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*_cols(by), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    size = Window.partitionBy(*_cols(by))
    return counts.withColumn("density", F.col("n") * bins / F.sum("n").over(size))


def compare_importance(a: DataFrame, b: DataFrame, key: str = "predictor", value: str = "importance") -> DataFrame:
    """Distance of two importance tables by value and by average rank (one row per predictor each)."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)

    def average_rank(c):
        whole = Window.partitionBy(F.lit(1)).orderBy(c)
        return F.rank().over(whole) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2

    ranked = both.withColumns({"ra": average_rank("a"), "rb": average_rank("b")})
    l2 = lambda p, q: F.sqrt(F.sum((F.col(p) - F.col(q)) * (F.col(p) - F.col(q))))
    return ranked.agg(F.count(F.lit(1)).alias("n"), l2("a", "b").alias("l2"),
                      (l2("ra", "rb") / F.count(F.lit(1))).alias("l2_rank"))


def pooled_segments(df: DataFrame, segment: str, train: Column) -> DataFrame:
    """Scores of segment models pooled, each with the threshold of its own training rows; rows of a segment without
    training rows have none."""
    own = df.where(train)
    c = cumulate(own, [segment], "score")
    failures = own.groupBy(segment).agg(F.greatest(F.count_if(F.col("y") == 0), F.lit(1)).alias("__need"))
    limits = c.join(failures, segment).where(F.col("cum_n") >= F.col("__need")).groupBy(segment).agg(
        F.min("score").alias("threshold"))
    return df.where(~train).join(limits, segment, "left")

