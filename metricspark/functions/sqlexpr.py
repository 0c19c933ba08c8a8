"""SQL-text building blocks for wide projections.

A projection over dozens of generated columns is sent to the JVM as one
``selectExpr`` call instead of thousands of py4j calls for ``Column``
objects; the analysed plan is the same.
"""

from __future__ import annotations

import math


def q(name: str) -> str:
    """Backtick-quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def dlit(v) -> str:
    """Exact DOUBLE literal (shortest round-trip repr with the ``D`` suffix)."""
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"({v!r}D)"


def dcol(name: str) -> str:
    return f"CAST({q(name)} AS DOUBLE)"
