"""Long to wide, wide to long, densification, term slots."""

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.nulls import zero
from cohortlens.functions.terms import SLOTS, slot_name, year_slot
from cohortlens.operators.aggs import _cols, total_if


def widen(df: DataFrame, ids, key: str, cols, levels, agg=F.max, fill=None) -> DataFrame:
    """One column ``{col}_{level}`` per level; the level list makes it a single pass."""
    wide = df.groupBy(*_cols(ids)).agg(*[
        agg(F.when(F.col(key) == v, F.col(c))).alias(f"{c}_{v}") for c in cols for v in levels
    ])
    # Only the new columns: an id that was filled would be another column to the planner, which would deal the rows again.
    return wide if fill is None else wide.na.fill(fill, [f"{c}_{v}" for c in cols for v in levels])


def lengthen(df: DataFrame, ids, stubs: dict, key: str) -> DataFrame:
    """``stubs``: output column -> {level: wide column}; one row per id and level."""
    levels = list(next(iter(stubs.values())))
    rows = F.array(*[
        F.struct(F.lit(v).alias(key), *[F.col(m[v]).alias(out) for out, m in stubs.items()]) for v in levels
    ])
    return df.select(*_cols(ids), F.explode(rows).alias("__r")).select(*_cols(ids), "__r.*")


def calendar(df: DataFrame, key: str):
    """Sorted array of the observed keys (terms), a scalar whose size the calendar bounds."""
    return df.select(key).distinct().agg(F.sort_array(F.collect_list(key))).scalar()


def densify(df: DataFrame, ids, key: str) -> DataFrame:
    """Every id with every observed key."""
    grid = df.select(*_cols(ids)).distinct().select(*_cols(ids), F.explode(calendar(df, key)).alias(key))
    return grid.join(df, [*_cols(ids), key], "left")


def term_slots(df: DataFrame, entity: str, first: str, time: str, feats, slots=SLOTS) -> DataFrame:
    """Features as ``{feature}_{fa|sp|su}{year}`` with zero where nothing was observed."""
    label = df.withColumn("__slot", slot_name(F.col(first), F.col(time)))
    return widen(label, entity, "__slot", feats, slots, fill=0)


def year_buckets(df: DataFrame, entity: str, first: str, time: str, cols, years=range(1, 7)) -> DataFrame:
    slot = year_slot(F.col(first), F.col(time))
    return df.groupBy(entity).agg(*[
        total_if(F.col(c), slot == y).alias(f"{c}_yr{y}") for c in cols for y in years
    ])


def first_term_slot(feats) -> dict:
    """The only enrolled slot of the first year: fall, then spring, then summer takes precedence."""
    return {
        f"{f}_tm1": F.when(zero(F.col("enrolled_su1")) == 1, F.col(f"{f}_su1"))
        .when(zero(F.col("enrolled_sp1")) == 1, F.col(f"{f}_sp1"))
        .otherwise(F.col(f"{f}_fa1"))
        for f in feats
    }
