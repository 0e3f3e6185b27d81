"""Exact quantiles of keys that no task has to hold: counts of values, summed by bands of values.

A histogram has one row for each key and value. Its counts are summed for bands of BAND values; a running
sum over a key's bands says which bands hold the wanted ranks, and a running sum within these, which
values. A window holds a key's bands, or a band's values, never a key's rows; both are bounded by the
range of the values (ints), whatever the number of rows.

Histograms add up: of days to those of any stretch of days, of parts of a table to that of the table.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a band.
BAND = 4096


def same(a: str, b: str, keys: list[str]) -> Column:
    """Whether aliased tables a and b agree in keys, nulls with nulls."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def _ranks(n: Column, q: float) -> tuple[Column, Column, Column]:
    """The ranks (from 0) that a quantile of n values lies between, and how far it is on the way."""
    at = F.lit(q) * (n - 1)
    low = F.floor(at)
    return low, F.ceil(at), at - low


def exact(histogram: DataFrame, keys: list[str], value: str, counts: dict[str, str], qs: list[float]) -> DataFrame:
    """histogram: keys, an int value, and counts; one row for each key and value, of nulls none.
    keys, and for each name of counts {name: column} the number of values `n_{name}` and the array
    `q_{name}` of their quantiles by linear interpolation, nulls where there are none."""
    band = F.floor(F.col(value) / BAND).alias("_band")
    sums = histogram.groupBy(*keys, band).agg(*(F.sum(c).alias(f"_c_{n}") for n, c in counts.items()))
    by_key, of_key = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    bands = sums.select("*", *(F.coalesce(F.sum(f"_c_{n}").over(by_key), F.lit(0)).alias(f"_b_{n}") for n in counts), *(F.sum(f"_c_{n}").over(of_key).alias(f"_n_{n}") for n in counts))

    def holds(n: str, before: Column, count: Column) -> list[Column]:
        return [(r >= before) & (r < before + count) for q in qs for r in _ranks(F.col(f"_n_{n}"), q)[:2]]

    wanted = reduce(lambda x, y: x | y, (h for n in counts for h in holds(n, F.col(f"_b_{n}"), F.col(f"_c_{n}"))))
    # Bands without any value still stand for their key.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_band")) == 1
    bands = bands.withColumn("_first", first).where(wanted | F.col("_first"))
    inner = Window.partitionBy(*(f"h.{k}" for k in keys), "h._band").orderBy(f"h.{value}").rowsBetween(Window.unboundedPreceding, -1)
    h, b = histogram.withColumn("_band", band).alias("h"), bands.alias("b")
    j = h.join(b, same("h", "b", [*keys, "_band"]))
    before = {n: F.col(f"b._b_{n}") + F.coalesce(F.sum(f"h.{c}").over(inner), F.lit(0)) for n, c in counts.items()}
    rows = j.select(*(F.col(f"h.{k}").alias(k) for k in keys), F.col(f"h.{value}").alias("_v"), *(F.col(f"b._n_{n}").alias(f"_n_{n}") for n in counts),
                    *(before[n].alias(f"_b_{n}") for n in counts), *(F.col(f"h.{c}").alias(f"_c_{n}") for n, c in counts.items()))
    picks = [F.max(F.when(h, F.col("_v"))).alias(f"_p_{n}_{i}") for n in counts for i, h in enumerate(holds(n, F.col(f"_b_{n}"), F.col(f"_c_{n}")))]
    made = rows.groupBy(*keys).agg(*(F.max(f"_n_{n}").alias(f"n_{n}") for n in counts), *picks)

    def between(n: str, i: int, q: float) -> Column:
        low, high = F.col(f"_p_{n}_{2 * i}").cast("double"), F.col(f"_p_{n}_{2 * i + 1}").cast("double")
        return low + (high - low) * _ranks(F.col(f"n_{n}"), q)[2]

    return made.select(*keys, *(F.col(f"n_{n}") for n in counts), *(F.array(*(between(n, i, q) for i, q in enumerate(qs))).alias(f"q_{n}") for n in counts))


def daily(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, day, value, n): the histogram of each UTC day. Those of parts of a table may be appended."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.to_date(at).alias("day"), value).agg(F.count("*").alias("n"))


def rolled(days_of: DataFrame, keys: list[str], value: str, as_of: list[dt.date], days: int) -> DataFrame:
    """(keys, as_of, value, n): histograms of [as_of - days, as_of) for each of several days, from those of
    days, in one pass: a day counts for the as_of that it is in the look-back of."""
    ends = F.array(*(F.lit(d) for d in sorted(as_of)))
    seen = days_of.where((F.col("day") >= min(as_of) - dt.timedelta(days=days)) & (F.col("day") < max(as_of)))
    in_reach = F.filter(ends, lambda end: (F.col("day") < end) & (F.col("day") >= F.date_sub(end, days)))
    return seen.select(*keys, F.explode(in_reach).alias("as_of"), value, "n").groupBy(*keys, "as_of", value).agg(F.sum("n").alias("n"))
