"""Registered queries with an equivalent SQL statement for each one that has one."""


def load_all():
    """Import every catalog module and return (queries, equivalent SQL)."""
    import importlib
    import pkgutil

    from cohortlens.catalog.registry import ORACLE, QUERIES

    for module in pkgutil.iter_modules(__path__):
        if module.name not in ("registry", "view_sql"):
            importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLE
