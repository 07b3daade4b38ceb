"""Collects the bound queries and the SQL that answers the same question."""

_QUERIES = {}
_SQL = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name."""
    def register(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
