"""Bucketing expressions with the edge rules the features need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed(
    column: Column, edges: Sequence[float], labels: Sequence[float]
) -> Column:
    """Label of the interval ``(edges[i], edges[i + 1]]``; the last one is unbounded.

    Values at or below the first edge and nulls give null.
    """
    chosen = F.when(column <= edges[0], F.lit(None).cast("double"))
    for upper, label in zip(edges[1:], labels[:-1]):
        chosen = chosen.when(column <= upper, F.lit(float(label)))
    return chosen.when(column.isNotNull(), F.lit(float(labels[-1])))


def flag(condition: Column) -> Column:
    """1 or 0, with 0 for unknown."""
    return F.when(condition, 1).otherwise(0)


def lookup(column: Column, table: dict[str, float | int], otherwise: float | int) -> Column:
    """Value of a small fixed table by exact match."""
    chosen = None
    for key, value in table.items():
        chosen = (chosen.when if chosen is not None else F.when)(column == key, F.lit(value))
    return chosen.otherwise(F.lit(otherwise))
