"""Small column functions with the defined NULL rules."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column, digits: int | None = None) -> Column:
    """NULL where b is 0 or NULL."""
    out = a / F.when(b != 0, b)
    return out if digits is None else F.round(out, digits)


def flag_sum(*flags: str) -> Column:
    return reduce(add, (F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags))


def true_or_false(condition: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def clamp_low(x: Column, low: float = 0.0) -> Column:
    """NULL stays NULL."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins, the last one open; NULL stays NULL."""
    out = F.when(x <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(x <= edge, label)
    return out.when(x.isNotNull(), labels[-1])


def ordinal(x: Column, vocabulary: list[str]) -> Column:
    """Position in a fixed vocabulary; -1 for anything else."""
    pairs = [F.lit(v) for i, k in enumerate(vocabulary) for v in (k, i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(x, F.lit(""))), F.lit(-1))


def iso_weekday(ts: Column) -> Column:
    """Monday is 1."""
    return F.weekday(ts) + 1
