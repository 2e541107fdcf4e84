"""Measures from a score ledger: a stored table of counts by segment, group and distinct score.

Scored rows are read once. Every threshold, curve and rate of a model is then an aggregate over the ledger, whose size is the
number of distinct scores: running counts give order statistics (AUC, thresholds, cuts), sums of counts give rates. The
functions return what those of the same name in ``plans.measures`` return for the rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.nulls import ratio
from cohortlens.operators.aggs import _cols
from cohortlens.operators.ranking import cumulate_counts
from cohortlens.plans import measures as m
from cohortlens.sources.scan import sink

COUNTS = ["n", "positives"]


@dataclass(frozen=True)
class Ledger:
    """``cells``: stored (by..., score, n, positives, cum_n, cum_positives), running along the score within ``by``."""

    cells: DataFrame
    by: tuple

    def where(self, condition) -> "Ledger":
        """Some of its segments or groups, whole ones."""
        return Ledger(self.cells.where(condition), self.by)

    def along(self, by=()) -> DataFrame:
        """Running counts of coarser groups, from the counts of the cells."""
        by = _cols(by)
        if tuple(by) == self.by:
            return self.cells
        per = self.cells.groupBy(*by, "score").agg(*[F.sum(c).alias(c) for c in COUNTS])
        return cumulate_counts(per, by, "score", COUNTS)

    def with_threshold(self, train: "Ledger") -> DataFrame:
        return self.cells.withColumn("threshold", base_rate_threshold(train).scalar())


def ledger(scored: DataFrame, by, path: str, score: str = "score", y: str = "y") -> Ledger:
    """The ledger of scored rows, written to ``path``; rows without a score are left out. It is the one scan of the rows."""
    by = _cols(by)
    per = scored.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    counts = sink(per, f"{path}/counts")
    return Ledger(sink(cumulate_counts(counts, by, "score", COUNTS), f"{path}/running"), tuple(by))


def _total(x: Column, condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(x if condition is None else F.when(condition, x)), F.lit(0))


def _n() -> Column:
    return F.col("n")


def _pos() -> Column:
    return F.col("positives")


def _neg() -> Column:
    return F.col("n") - F.col("positives")


def _called() -> Column:
    return F.col("score") > F.col("threshold")


def auc(l: Ledger, by=()) -> DataFrame:
    below = F.col("cum_n") - F.col("cum_positives") - _neg()
    wins = F.sum(_pos() * (below + _neg() / 2))
    return l.along(by).groupBy(*_cols(by)).agg(ratio(wins, F.sum(_pos()) * F.sum(_neg())).alias("auc"), F.sum(_n()).alias("n"))


def base_rate_threshold(train: Ledger) -> DataFrame:
    c = train.along()
    failures = train.cells.agg(F.greatest(_total(_neg()), F.lit(1))).scalar()
    return c.where(F.col("cum_n") >= failures).agg(F.min("score").alias("threshold"))


def edge_values(l: Ledger, probs) -> list[float]:
    """Linearly interpolated quantiles of the score over all cells. One row with both neighbours of every position reaches
    the driver."""
    c = l.along().withColumn("__size", l.cells.agg(F.sum(_n())).scalar())
    ends = []
    for p in probs:
        place = F.lit(float(p)) * (F.col("__size") - 1)
        for at in (F.floor(place), F.ceil(place)):
            ends.append(F.max(F.when((at >= F.col("cum_n") - _n()) & (at < F.col("cum_n")), F.col("score"))))
        ends.append(F.max(place - F.floor(place)))
    row = c.agg(F.array(*ends).alias("e")).first()["e"]
    if row[0] is None:
        return []
    return [low + (high - low) * share for low, high, share in zip(row[::3], row[1::3], row[2::3])]


def success_rates(tested: DataFrame) -> DataFrame:
    agg = [_total(_n()).alias("n"), ratio(_total(_pos()), _total(_n())).alias("actual_rate"), ratio(_total(_n(), _called()), _total(_n())).alias("pred_rate")]
    table = tested.cube("grp").agg(F.grouping("grp").alias("__all"), *agg).withColumn(
        "grp", F.when(F.col("__all") == 1, "overall").otherwise(F.col("grp"))).drop("__all")
    found = m.against_reference(table, {"p_actual": ("proportion", "n", "actual_rate"), "p_pred": ("proportion", "n", "pred_rate")})
    return found.withColumns({c: F.when(F.col("grp") != "overall", F.col(c)) for c in ("p_actual", "p_pred")})


def tpr_bias(tested: DataFrame) -> DataFrame:
    table = tested.groupBy("grp").agg(_total(_pos()).alias("n"), ratio(_total(_pos(), _called()), _total(_pos())).alias("tpr"))
    return m.against_reference(table, {"p_value": ("proportion", "n", "tpr")})


def fpr_precision0_bias(tested: DataFrame) -> DataFrame:
    below = ~_called()
    table = tested.groupBy("grp").agg(
        _total(_n(), below).alias("n_below"), (1 - ratio(_total(_pos(), below), _total(_n(), below))).alias("precision_0"),
        _total(_neg()).alias("n_failed"), ratio(_total(_neg(), _called()), _total(_neg())).alias("fpr"))
    return m.against_reference(table, {"p_precision_0": ("proportion", "n_below", "precision_0"), "p_fpr": ("proportion", "n_failed", "fpr")})


def _balanced() -> Column:
    return m.balanced(ratio(_total(_pos(), _called()), _total(_pos())), ratio(_total(_neg(), ~_called()), _total(_neg())))


def balanced_accuracy(tested: DataFrame, by=()) -> DataFrame:
    return tested.groupBy(*_cols(by)).agg(_balanced().alias("balanced_accuracy"))


def bas_bias(tested: DataFrame) -> DataFrame:
    table = tested.groupBy("grp").agg(_total(_n()).alias("n"), _balanced().alias("balanced_accuracy"))
    return m.against_reference(table, {"p_value": ("proportion", "n", "balanced_accuracy")})


def class_report(tested: DataFrame, by=()) -> DataFrame:
    out = tested.groupBy(*_cols(by)).agg(_total(_pos(), _called()).alias("tp"), _total(_pos(), ~_called()).alias("fn"),
                                         _total(_neg(), ~_called()).alias("tn"), _total(_neg(), _called()).alias("fp"))
    c = F.col
    p1, r1 = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    p0, r0 = ratio(c("tn"), c("tn") + c("fn")), ratio(c("tn"), c("tn") + c("fp"))
    return out.select(*_cols(by), p1.alias("precision_1"), r1.alias("recall_1"), ratio(2 * p1 * r1, p1 + r1).alias("f1_1"),
                      p0.alias("precision_0"), r0.alias("recall_0"), ratio(2 * p0 * r0, p0 + r0).alias("f1_0"))


def score_bias(l: Ledger, by=()) -> DataFrame:
    by, s = _cols(by), F.col("score")
    mean = ratio(F.sum(_n() * s), F.sum(_n()))
    table = l.cells.groupBy(*by, "grp").agg(F.sum(_n()).alias("n"), (mean - ratio(F.sum(_pos()), F.sum(_n()))).alias("gap"),
                                            (ratio(F.sum(_n() * s * s), F.sum(_n())) - mean * mean).alias("variance"))
    return m.against_reference(table, {"p_value": ("mean", "n", "gap", "variance")}, by=by)


def calibration_curve(l: Ledger, bins: int = 50) -> DataFrame:
    """Needs distinct edges: ranks within a score aren't in the ledger."""
    edges = edge_values(l, [i / bins for i in range(1, bins)])
    if len(set(edges)) < len(edges):
        raise ValueError("edges repeat; take measures.calibration_curve of the rows")
    table = l.cells.groupBy("grp", m.bin_of(F.col("score"), edges).alias("bin")).agg(
        F.sum(_n()).alias("n"), ratio(F.sum(_pos()), F.sum(_n())).alias("rate"))
    return table.withColumn("pct", ((2 * F.col("bin") - 1) * (50.0 / bins)).cast("double"))


def parity_at(l: Ledger, deciles=m.MARKED_DECILES) -> DataFrame:
    table = calibration_curve(l, 10).withColumn("pct", 10 * F.col("bin") - 5).where(F.col("pct").isin(list(deciles)))
    return m.against_reference(table.select("pct", "grp", "n", "rate"), {"p_value": ("proportion", "n", "rate")}, by="pct")


def precision0_tnr(l: Ledger, cuts=m.CUTS, groups=(m.REFERENCE, m.TARGET)) -> DataFrame:
    aggs = []
    for cut, e in zip(cuts, edge_values(l, cuts)):
        below = F.col("score") < F.lit(e)
        aggs.append(F.struct(
            F.lit(cut).alias("cut"), _total(_n(), below).alias("n_below"), (1 - ratio(_total(_pos(), below), _total(_n(), below))).alias("precision_0"),
            _total(_neg()).alias("n_failed"), ratio(_total(_neg(), below), _total(_neg())).alias("tnr")))
    rows = l.cells.where(F.col("grp").isin(list(groups))).groupBy("grp").agg(F.array(*aggs).alias("__a")).select(
        "grp", F.explode("__a").alias("__r")).select("grp", "__r.*")
    se = lambda p, n: F.sqrt(ratio(F.col(p) * (1 - F.col(p)), F.col(n)))
    return rows.select("grp", "cut", "precision_0", se("precision_0", "n_below").alias("se_precision_0"), "tnr", se("tnr", "n_failed").alias("se_tnr"))


def pr_threshold(l: Ledger, by=(), cap: float = 0.8) -> DataFrame:
    by = _cols(by)
    c = l.along(by)
    totals = l.cells.groupBy(*by).agg(F.sum(_n()).alias("__n"), F.sum(_pos()).alias("__p"))
    c = c.join(totals, by) if by else c.withColumn("__t", totals.select(F.struct("__n", "__p")).scalar()).select("*", "__t.*")
    tp = F.col("__p") - (F.col("cum_positives") - _pos())
    called = F.col("__n") - (F.col("cum_n") - _n())
    marked = c.where(F.col("score") < cap).withColumn("__f1", ratio(2 * tp, called + F.col("__p"))).where("__f1 is not null")
    return marked.groupBy(*by).agg(F.min_by("score", F.struct(-F.col("__f1"), F.col("score"))).alias("threshold"), F.max("__f1").alias("f1"))


def report(l: Ledger, train: Column, test: Column, bins: int = 10) -> DataFrame:
    """(measure, grp, at, value): all measures of a model by group, from its ledger (by a split and ``grp``)."""
    fitted, held = l.where(train), l.where(test)
    tested = held.with_threshold(fitted)
    none = F.lit(None).cast("double")

    def long(table: DataFrame, values, grp="grp", at=none) -> DataFrame:
        items = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("value")) for name, c in values.items()])
        rows = table.select((F.col(grp) if grp else F.lit("overall")).alias("grp"), at.cast("double").alias("at"), F.explode(items).alias("v"))
        return rows.select("v.measure", "grp", "at", "v.value")

    same = lambda *names: {n: n for n in names}
    parts = [
        long(auc(held, "grp"), same("auc", "n")), long(auc(held), {"auc": "auc"}, None),
        long(base_rate_threshold(fitted), same("threshold"), None),
        long(success_rates(tested), same("actual_rate", "pred_rate", "p_actual", "p_pred")),
        long(tpr_bias(tested), {"tpr": "tpr", "p_tpr": "p_value"}),
        long(fpr_precision0_bias(tested), same("precision_0", "fpr", "p_precision_0", "p_fpr")),
        long(bas_bias(tested), {"balanced_accuracy": "balanced_accuracy", "p_balanced_accuracy": "p_value"}),
        long(score_bias(held), {"score_gap": "gap", "p_score_gap": "p_value"}),
        long(calibration_curve(held, bins), {"calibration": "rate"}, at=F.col("pct")),
        long(precision0_tnr(held), {"precision_0_below": "precision_0", "tnr_below": "tnr"}, at=F.col("cut")),
        long(pr_threshold(fitted), {"pr_threshold": "threshold", "pr_f1": "f1"}, None)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
