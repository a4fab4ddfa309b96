"""Exact rounding helpers.

Money stays in decimals; ratios are computed on integers and rounded half up,
so a result does not depend on the order rows were added in or on how an engine
rounds binary fractions.  Doubles appear only at the edge of a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def cents(money: Column) -> Column:
    return (money * 100).cast(WHOLE)


def divide_half_up(numerator: Column, denominator: Column) -> Column:
    """Integer quotient rounded half away from zero; NULL for a zero denominator."""
    sign = F.signum(numerator.cast("double")).cast("bigint") * F.signum(
        denominator.cast("double")
    ).cast("bigint")
    top, bottom = F.abs(numerator.cast(WHOLE)), F.abs(denominator.cast(WHOLE))
    quotient = F.call_function("div", top * 2 + bottom, F.nullif(bottom * 2, F.lit(0)))
    return quotient * sign


def money_double(money: Column) -> Column:
    return money.cast("double")


def average_money(total: Column, count: Column) -> Column:
    """``total / count`` to the cent as DOUBLE, 0.0 when there is nothing to divide by."""
    return F.coalesce(divide_half_up(cents(total), count).cast("double") / 100, F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to one decimal as DOUBLE, NULL for a zero whole."""
    return divide_half_up(part.cast(WHOLE) * 1000, whole).cast("double") / 10


def share(part: Column, whole: Column) -> Column:
    """:func:`percent`, 0.0 for a zero whole."""
    return F.coalesce(percent(part, whole), F.lit(0.0))
