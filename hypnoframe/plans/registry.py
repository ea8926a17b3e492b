"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

import re

from hypnoframe.plans import kernel_sql, proven, relational, scripted, tools, views

QUERIES: dict = relational.QUERIES | scripted.QUERIES | proven.QUERIES | kernel_sql.QUERIES | views.QUERIES | tools.QUERIES
ORACLE: dict = relational.ORACLE | scripted.ORACLE | proven.ORACLE | kernel_sql.ORACLE | views.ORACLE | tools.ORACLE


def _doubles(sql: str) -> str:
    """Decimal fractions outside quotes written as doubles: elsewhere 0.5 is a DECIMAL, and so is what is made of it."""
    parts = re.split(r"""('[^']*'|"[^"]*")""", sql)
    return "".join(p if k % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for k, p in enumerate(parts))


ORACLE = {name: _doubles(sql) for name, sql in ORACLE.items()}
