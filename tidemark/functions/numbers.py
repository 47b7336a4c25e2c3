"""Rounding as SQL engines on binary doubles do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: str | Column, places: int) -> Column:
    """Half away from zero of the scaled double; ``round(x, n)`` of Spark rounds the shortest decimal text of ``x`` instead.

    The two differ at ties: 20.275 is scaled to 2027.4999999999998, so it gives 20.27 here and 20.28 there.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**places))
    return F.round(value * scale) / scale
