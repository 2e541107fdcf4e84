"""Query registry: a callable on the records views plus an optional equivalent SQL statement."""

import re

from cohortlens.catalog.view_sql import VIEW_SQL
from cohortlens.sources.tables import Records

QUERIES = {}
ORACLE = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the common table expressions of the views it names."""
    needed = []

    def visit(body):
        for name, view in VIEW_SQL.items():
            if re.search(rf"\b{name}\b", body) and name not in needed:
                visit(view)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Records(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register
