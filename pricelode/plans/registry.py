"""The registered queries and the SQL that checks them, by name."""

from __future__ import annotations

from ..sources import testdata

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, derived: bool = True):
    """Registers a query; derived: its SQL is over the derived tables of testdata."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (testdata.CTES if derived else "") + sql
        return f

    return add
