"""An integer hash that numpy, Spark and other SQL engines compute alike.

``h(a, b, salt)``: with P = PRIME, x = (a mod P * 48271 + b mod P * 69621 + salt) mod P,
y = (x * x + 40692 * x) mod P, h = (y * 39373 + x) mod P.  No product exceeds 63 bits; remainders are not
negative.  Values lie in 0 to P - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = 2_147_483_647


def hashed(a, b, salt: int):
    """Of numpy arrays, Python integers or columns of long type that are not negative."""
    x = (a % PRIME * 48271 + b % PRIME * 69621 + salt) % PRIME
    y = (x * x + 40692 * x) % PRIME
    return (y * 39373 + x) % PRIME


def hashed_sql(a: str, b: str, salt: int, pmod: str = "pmod({}, {})") -> str:
    """The same as SQL text, of any 64-bit integers."""
    x = f"(({pmod.format(a, PRIME)} * 48271 + {pmod.format(b, PRIME)} * 69621 + {salt}) % {PRIME})"
    y = f"(({x} * {x} + 40692 * {x}) % {PRIME})"
    return f"(({y} * 39373 + {x}) % {PRIME})"


def integer_id(df: DataFrame, col: str) -> Column:
    """An id as a long: integers as they are, ids of other types by their 64-bit hash."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("long")
    return F.xxhash64(c)
