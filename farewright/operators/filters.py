"""Filters of the deal list: parsing, presets, and the predicates they stand for."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.dims import REGIONS, SOURCES
from farewright.functions.dates import lit_time

FLOOR = 50_000
SINCE = {"24h": dt.timedelta(hours=24), "7d": dt.timedelta(days=7), "30d": dt.timedelta(days=30)}


@dataclass(frozen=True)
class Filters:
    region: str = "all"
    max_price: int | None = None
    month: str | None = None
    min_discount: int = 0
    since: str = "all"


def parse_filters(params: dict[str, str]) -> Filters:
    """From URL parameters; what is not valid counts as absent."""
    get = lambda k: params.get(k) or ""
    price = int(get("maxPrice")) if re.fullmatch(r"\d{1,9}", get("maxPrice")) else 0
    pct = int(get("minDiscount")) if re.fullmatch(r"\d{1,3}", get("minDiscount")) else 0
    return Filters(
        get("region") if get("region") in REGIONS else "all", min(price, 10_000_000) if price > 0 else None,
        get("month") if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", get("month")) else None, min(100, pct), get("since") if get("since") in SINCE else "all")


def to_params(f: Filters) -> dict[str, str]:
    """URL parameters without those at their default; parse_filters gives the filters back."""
    names = {"region": "region", "max_price": "maxPrice", "month": "month", "min_discount": "minDiscount", "since": "since"}
    default = asdict(Filters())
    return {names[k]: str(v) for k, v in asdict(f).items() if v != default[k]}


def presets(today: dt.date) -> dict[str, dict]:
    summer = today.year + (today.month > 7)
    return {
        "jp-under-300k": {"region": "JP", "max_price": 300_000}, "big-discount": {"min_discount": 30}, "summer": {"month": f"{summer}-07"},
        "fresh-24h": {"since": "24h"}, "us-under-1m": {"region": "US", "max_price": 1_000_000}, "sea": {"region": "SEA"}}


def preset_active(f: Filters, preset: dict) -> bool:
    return all(getattr(f, k) == v for k, v in preset.items())


def toggle_preset(f: Filters, preset: dict) -> Filters:
    return Filters() if preset_active(f, preset) else replace(Filters(), **preset)


def in_region(destination: Column, region: str) -> Column:
    return F.lit(True) if region == "all" else destination.isin(REGIONS[region])


def not_past(depart: Column, as_of: dt.datetime) -> Column:
    return depart.isNull() | (depart >= F.lit(as_of.date()))


def is_live(as_of: dt.datetime) -> Column:
    return (F.col("expires_at") > lit_time(as_of)) & (F.col("verification_status") != "snapshot")


def since_cutoff(f: Filters, as_of: dt.datetime) -> dt.datetime | None:
    return as_of - SINCE[f.since] if f.since in SINCE else None


def common(df: DataFrame, f: Filters, as_of: dt.datetime, apply_since: bool = True) -> DataFrame:
    """Region, price, discount, since and month. A null discount fails a discount filter; the month
    is the calendar month of depart_from."""
    df = df.where(in_region(F.col("destination"), f.region))
    if f.max_price is not None:
        df = df.where(F.col("price_krw") <= f.max_price)
    if f.min_discount > 0:
        df = df.where(F.col("discount_rate") >= f.min_discount / 100)
    if apply_since and (cut := since_cutoff(f, as_of)):
        df = df.where(F.col("posted_at") >= lit_time(cut))
    if f.month:
        first = dt.date.fromisoformat(f"{f.month}-01")
        after = dt.date(first.year + first.month // 12, first.month % 12 + 1, 1)
        df = df.where((F.col("depart_from") >= F.lit(first)) & (F.col("depart_from") < F.lit(after)))
    return df


def known_sources(sources: Column) -> Column:
    return F.filter(sources, lambda s: s.isin(SOURCES))


def is_deal_id(value: str) -> bool:
    return re.fullmatch(r"[0-9a-fA-F-]{8,40}", value) is not None


def watch_errors(origin: str, destination: str, max_price: int, month: str | None, carrier_class: str = "mixed") -> list[str]:
    """What is wrong with a watch's input; empty if nothing."""
    return [what for what, bad in {
        "origin": not re.fullmatch(r"[A-Z]{3}", origin or ""), "destination": not re.fullmatch(r"[A-Z]{3}", destination or ""),
        "max_price": not 50_000 <= max_price <= 10_000_000, "month": month is not None and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month),
        "carrier_class": carrier_class not in ("fsc", "lcc", "mixed")}.items() if bad]


def search(items: DataFrame, typed: str, label: str = "label", order: str = "ord") -> DataFrame:
    """Palette search: case-insensitive substring; 12 rows for a blank query, 20 for a typed one."""
    q = typed.strip().lower()
    hit = items.where(F.lower(label).contains(q)) if q else items
    return hit.orderBy(order).limit(20 if q else 12)
