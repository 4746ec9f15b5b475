"""Training-data operators at corpus scale, with their queries and SQL."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
