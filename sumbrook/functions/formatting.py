"""Numbers as text: blanks between thousands, a decimal comma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"


def format_number(c: Column, decimals: int = 0) -> Column:
    return F.translate(F.format_number(c.cast("double"), decimals), ",.", " ,")


def format_metric(c: Column, unit: str) -> Column:
    """Percent with two decimals, KZT in millions or billions from there on, other units as whole numbers; null is a dash."""
    if unit == "%":
        text = F.concat(format_number(c, 2), F.lit("%"))
    elif unit == "KZT":
        size = F.abs(c)
        text = (
            F.when(size >= 1e9, F.concat(format_number(c / 1e9, 2), F.lit(" bn KZT")))
            .when(size >= 1e6, F.concat(format_number(c / 1e6, 2), F.lit(" m KZT")))
            .otherwise(F.concat(format_number(c), F.lit(" KZT")))
        )
    else:
        text = format_number(c)
    return F.when(c.isNull(), MISSING).otherwise(text)
