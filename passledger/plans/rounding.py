"""Rounding shared by the registered queries, so both engines print alike."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums run in different orders, so a value that lies exactly between two
# printed values could go either way; the nudge decides such ties alike.
NUDGE = 1e-9
_SQL = "CASE WHEN round({0} + 1e-9, {1}) = 0 THEN 0.0 ELSE round({0} + 1e-9, {1}) END"


def r(value: Column | str, digits: int = 6, nudge: Column | float = NUDGE) -> Column:
    """Round and turn a negative zero into zero.

    Values that another way to compute them misses by more than the nudge need a larger one.
    """
    column = F.col(value) if isinstance(value, str) else value
    rounded = F.round(column + (nudge if isinstance(nudge, Column) else F.lit(nudge)), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def rd(expression: str, digits: int = 6) -> str:
    """The same as SQL text."""
    return _SQL.format(f"({expression})", digits)
