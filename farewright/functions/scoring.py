"""Discount rate, estimated percentile and hot flag of a price against a baseline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farewright.functions.jsmath import round_half_up

HOT_PERCENTILE = 10


def estimate_percentile(price: Column, p10: Column, p50: Column, p90: Column) -> Column:
    """Piecewise linear through (p10, 10), (p50, 50), (p90, 90); null if those are not in order."""
    low = F.when(p10 <= 0, 0.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), price / F.nullif(p10, F.lit(0)) * 10)))
    mid = F.when(p50 == p10, 10.0).otherwise(10 + 40 * (price - p10) / F.nullif(p50 - p10, F.lit(0)))
    high = F.when(p90 == p50, 50.0).otherwise(50 + 40 * (price - p50) / F.nullif(p90 - p50, F.lit(0)))
    top = F.least(F.lit(100.0), 90 + 10 * (price - p90) / F.greatest(F.lit(1), p90))
    broken = p10.isNull() | p50.isNull() | p90.isNull() | price.isNull() | (p10 > p50) | (p50 > p90)
    return F.when(broken, F.lit(None).cast("double")).when(price <= p10, low).when(price <= p50, mid).when(price <= p90, high).otherwise(top)


def discount_rate(price: Column, p50: Column) -> Column:
    return F.when(p50 > 0, round_half_up((p50 - price) / F.nullif(p50, F.lit(0)), 3))


def score(price: Column, p10: Column, p50: Column, p90: Column, confidence: Column) -> dict[str, Column]:
    """discount_rate (3 digits), price_percentile (2 digits) and hot_deal, which goes by the
    percentile before rounding and needs a medium or high confidence."""
    pct = estimate_percentile(price, p10, p50, p90)
    hot = (pct <= HOT_PERCENTILE) & confidence.isin("medium", "high")
    return {
        "discount_rate": discount_rate(price, p50), "price_percentile": round_half_up(pct, 2), "hot_deal": F.coalesce(hot, F.lit(False))}
