"""Joins shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal columns where null equals null, as it does in grouping; keeps `left`'s columns."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in on])
