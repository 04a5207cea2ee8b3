"""Money arithmetic of sale lines and marts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def line_gross(quantity: Column, unit_price: Column, discount: Column) -> Column:
    """Discounted line value, rounded half-up to cents.

    A DECIMAL discount keeps the whole product exact; a DOUBLE one turns it into
    floating point before rounding.
    """
    return F.round(quantity * unit_price * (F.lit(1) - discount), 2)


def line_cost(quantity: Column, unit_cost: Column) -> Column:
    return F.round(quantity * unit_cost, 2)


def half_up_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` to ``digits`` places; NULL where the divisor is zero.

    Over aggregates this is a plain CASE on purpose: Spark evaluates ``nullif`` in a
    projection of its own, past which no anti-join moves below the aggregate.
    """
    return F.when(denominator != 0, F.round(numerator / denominator, digits))
