"""Running values over long histories: a distributed prefix scan.

A plain window over a key puts all rows of the key into one task, and one key may hold a large part of the table.
``in_order`` deals the rows by ranges of (key, order), so that a key of any size is spread over as many tasks as it
needs.  ``carry`` runs inside each range and adds what earlier ranges of the key hold.  At most one key goes on from
one range into the next, so the values carried are at most one row per range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shape import materialize

RANGE = "_range"


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], store: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """All rows in one total order, with the number of their range.  Written once: both branches of a scan must see the
    same ranges.  Order columns ascend, nulls first; rows equal in all of them must be interchangeable."""
    columns = [F.asc_nulls_first(c) for c in (*by, *order)]
    return store(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(RANGE, F.spark_partition_id()))


def carry(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]],
          store: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Add running columns ``{name: (kind, value)}`` over each key (over the whole table without one).

    Kinds: ``last`` (latest non-null so far), ``sum`` (with the row itself), ``max_before`` (over earlier rows) and
    ``previous`` (the value of the row before, null for the first).  A table from ``in_order`` keeps its ranges, so
    that several scans share one order; any other is ordered here and loses the number again.
    """
    held = RANGE in df.columns
    if not held:
        df = in_order(df, by, order, store)
    sort = [F.asc_nulls_first(c) for c in order]
    inside_range = Window.partitionBy(RANGE, *by).orderBy(*sort)
    up_to = inside_range.rowsBetween(Window.unboundedPreceding, 0)
    before = inside_range.rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*by).orderBy(RANGE)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order) if order else F.lit(0)
    inside, per_range, carried = [], [], []
    for name, (kind, value) in values.items():
        if kind == "previous":
            value = F.struct(value.alias("v"))
        df = df.withColumn(f"_v_{name}", value)
        v, i, c = F.col(f"_v_{name}"), f"_i_{name}", f"_c_{name}"
        if kind in ("last", "previous"):
            inside.append(F.last(v, ignorenulls=True).over(up_to if kind == "last" else before).alias(i))
            per_range.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(c))
            carried.append(F.last(c, ignorenulls=True).over(earlier).alias(c))
        elif kind == "sum":
            inside.append(F.sum(v).over(up_to).alias(i))
            per_range.append(F.sum(v).alias(c))
            carried.append(F.sum(c).over(earlier).alias(c))
        else:
            inside.append(F.max(v).over(before).alias(i))
            per_range.append(F.max(v).alias(c))
            carried.append(F.max(c).over(earlier).alias(c))
    totals = df.groupBy(RANGE, *by).agg(*per_range)
    numbered = totals.select(F.col(RANGE).alias("_range_there"), *(F.col(f"`{k}`").alias(f"_key_there{n}") for n, k in enumerate(by)),
                             *carried, F.row_number().over(ranges).alias("_nth_range"))
    # at most one key a range has an earlier range, so this is no larger than the number of partitions
    offsets = F.broadcast(numbered.where("_nth_range > 1").drop("_nth_range"))
    same = F.col(RANGE) == F.col("_range_there")
    for n, k in enumerate(by):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_key_there{n}"))
    out = df.select("*", *inside).join(offsets, same, "left")
    for name, (kind, _) in values.items():
        i, c = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            out = out.withColumn(name, F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
        elif kind == "max_before":
            out = out.withColumn(name, F.greatest(i, c))
        elif kind == "previous":
            out = out.withColumn(name, F.coalesce(i, c)["v"])
        else:
            out = out.withColumn(name, F.coalesce(i, c))
    extra = [f"_{k}_{n}" for n in values for k in ("v", "i", "c")] + ["_range_there", *(f"_key_there{n}" for n in range(len(by)))]
    return out.drop(*extra) if held else out.drop(*extra, RANGE)
