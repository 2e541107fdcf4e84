"""Projections, filters, row updates, fills."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.codes import GROUPS
from cohortlens.functions.nulls import flag, is_true, text, zero


def project(df: DataFrame, keep=None, drop=(), rename=None) -> DataFrame:
    if keep is not None:
        df = df.select(*keep)
    return df.drop(*drop).withColumnsRenamed(rename or {})


def keep_if(df: DataFrame, cond: Column) -> DataFrame:
    """Filter in which an unknown condition is false."""
    return df.where(is_true(cond))


def drop_if(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows for which the condition holds; unlike ``where(~cond)`` unknown rows stay."""
    return df.where(~is_true(cond))


def update_if(df: DataFrame, col: str, value, cond: Column) -> DataFrame:
    return df.withColumn(col, F.when(is_true(cond), value).otherwise(F.col(col)))


def dedupe(df: DataFrame, keys=None) -> DataFrame:
    """Exact duplicates, or one row per key when the other columns agree within a key."""
    return df.distinct() if keys is None else df.dropDuplicates(list(keys))


def one_hot(df: DataFrame, col: str, levels, baseline=None, prefix=None) -> DataFrame:
    """0/1 column per level except the baseline; the level list is part of the data contract."""
    prefix = prefix or col
    return df.withColumns({
        f"{prefix}_{str(v).lower().replace(' ', '_')}": flag(F.col(col) == v) for v in levels if v != baseline
    })


def college_type(four_year: Column, public: Column, instate: Column) -> Column:
    """1-8 code of three 0/1 flags."""
    return (4 * four_year + 2 * public + instate + 1).cast("int")


def group_label(df: DataFrame, out: str = "grp", flags=GROUPS) -> DataFrame:
    """Single category from 0/1 flags by precedence; rows with no flag are dropped."""
    label = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags])
    return df.withColumn(out, label).where(F.col(out).isNotNull())


def varying(df: DataFrame, cols) -> list[str]:
    """Columns with more than one value; one aggregate row reaches the driver."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def drop_constant(df: DataFrame, cols) -> DataFrame:
    kept = set(varying(df, cols))
    return df.drop(*[c for c in cols if c not in kept])


def collapse_rare(df: DataFrame, col: str, share: float, bucket) -> DataFrame:
    """Levels held by fewer than ``share`` of all rows become ``bucket``."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rare = (
        df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") < total * share)
        .select(F.col(col).alias("__level"))
    )
    marked = df.join(rare, df[col].eqNullSafe(rare["__level"]), "left").select(
        *[df[c] for c in df.columns if c != col],
        F.when(rare["__level"].isNotNull(), F.lit(bucket)).otherwise(df[col]).alias(col),
    )
    return marked.select(*df.columns)


def sentinel_encode(df: DataFrame, cols, gate: str, fit_on: Column | None = None) -> DataFrame:
    """Where the gate is off, put ``min(col) - 1``: below every real value."""
    fitted = df if fit_on is None else df.where(fit_on)
    row = fitted.agg(F.struct(*[F.min(c).alias(c) for c in cols])).scalar()
    off = ~is_true(F.col(gate) == 1)
    return df.withColumn("__low", row).withColumns(
        {c: F.when(off, F.col("__low")[c] - 1).otherwise(F.col(c)) for c in cols}
    ).drop("__low")


def impute_mean(df: DataFrame, cols, fit_on: Column, gate: Column | None = None) -> DataFrame:
    """Fill missing values with the mean over fitted rows where the gate is on."""
    wanted = fit_on if gate is None else fit_on & gate
    row = df.where(is_true(wanted)).agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    return df.withColumn("__mean", row).withColumns(
        {c: F.coalesce(F.col(c), F.col("__mean")[c]) for c in cols}
    ).drop("__mean")


def fill_mean(df: DataFrame, col: str, cond: Column | None = None) -> DataFrame:
    """Fill missing values with the mean over the rows where ``cond`` holds; only those rows are filled."""
    base = df if cond is None else keep_if(df, cond)
    mean = base.agg(F.avg(col)).scalar()
    fill = F.col(col).isNull() if cond is None else F.col(col).isNull() & is_true(cond)
    return df.withColumn(col, F.when(fill, mean).otherwise(F.col(col)))


def has_and_zero(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({f"has_{c}": flag(F.col(c).isNotNull()) for c in cols}).withColumns(
        {c: zero(F.col(c)) for c in cols})


def row_total(cols) -> Column:
    return reduce(lambda a, b: a + b, [zero(F.col(c)) for c in cols])


def row_max(cols) -> Column:
    return F.greatest(*[F.col(c) for c in cols])


def clean_text_numbers(df: DataFrame, rules: dict) -> DataFrame:
    """``rules``: column -> {marker text: replacement text or None}; the result is numeric."""
    out = {}
    for col, markers in rules.items():
        value = F.col(col)
        for marker, replacement in markers.items():
            value = F.when(text(F.col(col)) == marker, F.lit(replacement)).otherwise(value)
        out[col] = value.try_cast("double")
    return df.withColumns(out)
