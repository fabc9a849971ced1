"""All core queries by name, with the SQL they are checked against."""

from __future__ import annotations


def _modules():
    from . import queries
    from .sources import program_lines

    return [queries, program_lines]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE_SQL.items()}
