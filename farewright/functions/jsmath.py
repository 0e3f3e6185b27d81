"""Rounding and null rules that results must agree on: halves go up, also below zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits; unlike round(), -2.5 gives -2."""
    if digits == 0:
        return F.floor(x + 0.5)
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def round_int(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def round_quantile(x: Column) -> Column:
    """An interpolated value to an int. Engines differ in its last bits, which must not decide a
    half; so it is first cut to six digits."""
    return round_int(F.round(x, 6))


def blend(observed: Column, seed: Column) -> Column:
    """0.6 observed + 0.4 seed; the one that is there if the other is null."""
    return F.coalesce(observed * 0.6 + seed * 0.4, observed, seed)


def min_ignoring_null(a: Column, b: Column) -> Column:
    return F.least(a, b)
