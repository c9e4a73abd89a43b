"""Exact money arithmetic on decimal columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(total: Column) -> Column:
    """An exactly summed decimal, shown as a double."""
    return total.cast("double")


def mean(total: Column, n: Column) -> Column:
    """Average from an exact sum and a count; NULL when there is nothing to average."""
    return total.cast("double") / F.nullif(n, F.lit(0))


def pct_change(old: Column, new: Column) -> Column:
    """Change in percent of the old price, unrounded to 13 digits; NULL when the old price is not positive."""
    return F.when(old > 0, (new - old) / old * F.lit(100))


def stored_pct(pct: Column) -> Column:
    """Half-even to four digits as DECIMAL(8,4); NULL when it does not fit."""
    return F.bround(pct, 4).try_cast("decimal(8,4)")
