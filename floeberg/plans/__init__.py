"""Registered queries over the supplied tables, with their SQL."""


def queries() -> dict:
    from . import arrays, formats, more, solving, transforms  # noqa: F401  they register their queries
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import arrays, formats, more, solving, transforms  # noqa: F401
    from .registry import SQL

    return dict(SQL)
