"""Table contracts.

``assert_*`` look before something is done, in a job of their own. ``write_checked`` looks at a table that it has written, so the
table's plan runs once.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys) -> DataFrame:
    found = duplicate_keys(df, keys).take(1)
    if found:
        raise ValueError(f"key {keys} is not unique, e.g. {found[0].asDict()}")
    return df


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in (cols or df.columns)])


def assert_no_nulls(df: DataFrame, cols=None) -> DataFrame:
    bad = {c: n for c, n in null_counts(df, cols).first().asDict().items() if n}
    if bad:
        raise ValueError(f"missing values found: {bad}")
    return df


class ContractError(ValueError):
    """A written table breaks its contract; ``report`` has the figures, ``path`` the table."""

    def __init__(self, message: str, report: dict, path: str):
        super().__init__(f"{message}; written to {path}")
        self.report, self.path = report, path


def write_checked(df: DataFrame, path: str, unique=None, not_null=(), counts: dict | None = None, none_of=(),
                  drop=(), only: Column | None = None) -> tuple[DataFrame, dict]:
    """Write ``df`` as Parquet and check what was written: its plan runs once, and the figures come from a scan of the few columns
    that they need. Gives a scan of the table and a report: ``rows``, ``repeated`` (rows whose ``unique`` key is not), ``null <column>``
    for ``not_null``, and ``counts`` (name -> condition) of any other kind. Repeated keys, missing values and a count named by
    ``none_of`` raise a ``ContractError``.

    Keys are counted by a window on them, which needs no further shuffle where the last join or aggregate was on them.
    ``drop`` names columns that conditions need and the table does not. With ``only``, other rows are in the files and in ``counts``,
    but neither in the table nor in the rest of the report.
    """
    kept = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    figures: dict[str, Column] = {"rows": F.count_if(kept)}
    helpers = list(drop)
    if unique is not None:
        keys = [unique] if isinstance(unique, str) else list(unique)
        df = df.withColumn("__copies", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        figures["repeated"] = F.count_if(kept & (F.col("__copies") > 1))
        helpers.append("__copies")
    figures |= {f"null {c}": F.count_if(kept & F.col(c).isNull()) for c in not_null}
    figures |= {k: F.count_if(v) for k, v in (counts or {}).items()}
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    report = written.agg(*[v.alias(k) for k, v in figures.items()]).first().asDict()
    bad = {k: n for k, n in report.items() if n and (k == "repeated" or k.startswith("null ") or k in none_of)}
    if bad:
        raise ContractError(f"contract broken: {bad}", report, path)
    return (written if only is None else written.where(kept)).drop(*helpers), report
