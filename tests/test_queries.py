"""Every registered query against its SQL statement in DuckDB on the smallest data."""

import duckdb
import pytest

from cohortlens.catalog import load_all
from tools.check_queries import TABLES, norm, same

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(
        (v is not None, isinstance(v, str), (round(v, 5) if isinstance(v, float) else v) if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    expected = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert len(got) == len(expected)
    assert same(ordered(got), ordered(expected))


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_rows_only_queries_are_the_fitted_models():
    assert set(QUERIES) - set(ORACLE) == {
        "m02_random_forest", "m03_scores", "m05_tuning", "m06_logit", "g04_top_features", "m07_importance_by_group",
        "m25_counterfactual_rates", "l34_segment_scores", "m_variant_scores", "m_course_variant_scores"}
