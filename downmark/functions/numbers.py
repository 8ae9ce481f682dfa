"""Rounding and small-sample arithmetic shared by the operators, as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(value: str, digits: int = 6) -> str:
    """Half-up rounding by scaling, which any engine reproduces bit for bit."""
    scale = f"{10 ** digits}.0D"
    return f"floor(({value}) * {scale} + 0.5D) / {scale}"


def rnd(value, digits: int = 6) -> Column:
    """``r`` as a column; takes SQL text or a column."""
    if isinstance(value, str):
        return F.expr(r(value, digits))
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / scale


def div(top: str, bottom: str) -> str:
    """A double quotient, null where the bottom is zero."""
    return f"(double({top}) / nullif(double({bottom}), 0.0D))"
