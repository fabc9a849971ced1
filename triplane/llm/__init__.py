"""Operators for training data made from text: duplicates, leaks, look-alikes, canonical values, token ids, repair.

Nothing else in the library imports this package. queries() and oracle_sql() follow the contract of
the repository's entry module.
"""

from __future__ import annotations


def _modules():
    from . import canonical_values, crosssplit, formdupes, leakage, lookalikes, mojibake, tokens

    return [formdupes, crosssplit, lookalikes, canonical_values, tokens, leakage, mojibake]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    # Workers import the modules too: SQL that takes a while to make is made here only.
    return {name: sql for module in _modules() for name, sql in (module.oracle_sql() if hasattr(module, "oracle_sql") else module.ORACLE_SQL).items()}
