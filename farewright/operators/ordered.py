"""Places and running sums in large groups, by bands of the order.

A group's rows are cut into bands, by columns that rise with the order (the hour of a time, the value
that is sorted by, a thousand ids). What the bands before a row's own add up to comes from a window over
the group's bands, the rest from a window over the rows of one band, so no task has to sort a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewright.operators.quantiles import same


def id_band(rows: DataFrame, column: str) -> Column:
    """Bands of ids: 4096 numbers, or texts that begin alike."""
    kind = dict(rows.dtypes)[column]
    return F.floor(F.col(column) / 4096) if kind in ("int", "bigint", "smallint", "tinyint") else F.left(F.col(column).cast("string"), F.lit(4))


def before(rows: DataFrame, group: list[str], band: str, sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """rows, with the sums {name: aggregate} over the bands before their own in their group, and the totals
    {name: of which sum} of the group. Nulls of group and band stand together, nulls of a band first."""
    made = rows.groupBy(*group, band).agg(*(c.alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*group).orderBy(band).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    made = made.select(*group, band, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums), *(F.sum(n).over(whole).alias(t) for t, n in (totals or {}).items()))
    return rows.alias("r").join(made.alias("m"), same("r", "m", [*group, band])).select("r.*", *(f"m.{n}" for n in [*sums, *(totals or {})]))


def ranked(rows: DataFrame, group: list[str], bands: list[Column], order: list[Column | str], place: str = "place", size: str = "size") -> DataFrame:
    """rows with their place in their group (from 1, by order) and the group's size.

    bands: columns that order sorts by in effect, coarse to fine: of two rows, the one with the smaller
    band (the first that differs) is the earlier one."""
    names = [f"_band{i}" for i in range(len(bands))]
    out = rows.withColumns(dict(zip(names, bands)))
    for i, name in enumerate(names):
        out = before(out, [*group, *names[:i]], name, {f"_before{i}": F.count("*")}, {size: f"_before{i}"} if i == 0 else None)
    own = F.row_number().over(Window.partitionBy(*group, *names).orderBy(*order))
    at = sum((F.col(f"_before{i}") for i in range(len(names))), own)
    return out.withColumn(place, at).drop(*names, *(f"_before{i}" for i in range(len(names))))
