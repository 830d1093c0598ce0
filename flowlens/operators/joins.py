"""Join helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` with NULL equal to NULL (``<=>``), safe for two sides of one lineage.

    The right side's keys are renamed first, so a DataFrame can be joined with an aggregate of
    itself. ``<=>`` is still an equi-join key for the planner (hash or sort-merge join).
    """
    keys = list(keys)
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return out
    return out.drop(*[f"__r_{c}" for c in keys])
