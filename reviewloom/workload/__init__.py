"""Every operator bound to concrete tables, each next to its SQL twin."""

from . import cleaning, filters, keyed, languages, questions, streams, tenants  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
