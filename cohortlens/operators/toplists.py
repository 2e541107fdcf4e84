"""Sorts, top lists and frequent categories."""

from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.aggs import _cols, freq


def ordered(df: DataFrame, by) -> DataFrame:
    """Totally ordered rows: ranges of the whole key are sorted side by side, so a hot leading value is split."""
    return df.orderBy(*_cols(by))


def top_categories(df: DataFrame, col: str, k: int, exclude) -> DataFrame:
    """The k most frequent levels apart from the ``exclude`` bucket."""
    return freq(df, col).where(~F.col(col).eqNullSafe(F.lit(exclude))).orderBy(F.desc("n"), col).limit(k)


def frequent(df: DataFrame, col: str, n: int, exclude) -> DataFrame:
    return freq(df, col).where((F.col("n") >= n) & ~F.col(col).eqNullSafe(F.lit(exclude)))
