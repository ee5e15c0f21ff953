"""Differences and parts of timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed(unit_us: float, start: Column, end: Column) -> Column:
    """Exact elapsed time in units of unit_us microseconds; NULL if either is."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(unit_us))


def minutes(start: Column, end: Column) -> Column:
    return elapsed(6e7, start, end)


def hours(start: Column, end: Column) -> Column:
    return elapsed(3.6e9, start, end)


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """How many borders of the unit lie between, as SQL engines' datediff counts."""
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, start), F.date_trunc(unit, end))


def quarter_name(ts: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(ts).cast("string"))


def night(ts: Column) -> Column:
    return (F.hour(ts) >= 20) | (F.hour(ts) < 6)
