"""Global ranks, running values and neighbours without a one-task window.

Rows are sorted once into ranges of the full order and written; a row then knows its range
and its place inside. A small table with a row for each range supplies what stands
before it. Equal keys may lie in several ranges, so no key, not even a null one, makes a large
task, and the input is computed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.lineage import cut_lineage

_PLACE_BITS = 33


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in ranges of the order, with ``__part``, the number of a row's range, and ``__pos``, its place there from 0."""
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, pos = F.shiftright("__id", _PLACE_BITS).cast("int"), F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.withColumn("__part", part).withColumn("__pos", pos).drop("__id")


def _grouped(by: tuple[str, ...]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in by]


def _with_ranges(placed: DataFrame, by: tuple[str, ...], *table: Column, found: dict[str, Column]) -> DataFrame:
    """``placed`` with what ``found`` says of the earlier ranges of its group, by aggregates of each range.

    Without groups the table has a row for each range, and is sent to all tasks.
    """
    ranges = placed.groupBy(*by, "__part").agg(*table)
    names = [*by, "__part"]
    told = ranges.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(names)], *[c.alias(n) for n, c in found.items()])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(names)])
    return placed.join(told if by else F.broadcast(told), match).drop(*[f"__r{i}" for i in range(len(names))])


def _earlier(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def global_rank(df: DataFrame, key: Column, *order: Column, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """A dense 0-based ``rank`` over the total order ``(key, *order)``, ascending, within ``by``.

    ``order`` must break all ties, or equal rows are ranked in any order. Give a negated key for
    a descending one. Rows with a null key come first; a null group is a group.
    """
    placed = in_order(df, *_grouped(by), key.asc_nulls_first(), *order)
    before = F.coalesce(F.sum("__n").over(_earlier(by)), F.lit(0))
    told = _with_ranges(placed, by, F.min("__pos").alias("__first"), F.count("*").alias("__n"), found={"__low": F.col("__first"), "__before": before})
    return told.withColumn(name, (F.col("__pos") - F.col("__low") + F.col("__before")).cast("long")).drop("__part", "__pos", "__low", "__before")


def running_sums(df: DataFrame, key: Column, *order: Column, sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with inclusive running sums in the total order ``(key, *order)``, within ``by``."""
    placed = in_order(df, *_grouped(by), key.asc_nulls_first(), *order)
    before = {f"__b_{n}": F.coalesce(F.sum(f"__s_{n}").over(_earlier(by)), F.lit(0)) for n in sums}
    told = _with_ranges(placed, by, *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()], found=before)
    inside = Window.partitionBy(*by, "__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    out = told.select("*", *[(F.sum(c).over(inside) + F.col(f"__b_{n}")).alias(f"__o_{n}") for n, c in sums.items()])
    return out.select(*df.columns, *[F.col(f"__o_{n}").alias(n) for n in sums])


def running_max(df: DataFrame, value: str, *order: Column, name: str) -> DataFrame:
    """``df`` with the greatest value of the rows before, null for the first."""
    placed = in_order(df, *order)
    told = _with_ranges(placed, (), F.max(value).alias("__most"), found={"__before": F.max("__most").over(_earlier(()))})
    inside = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn(name, F.greatest(F.max(value).over(inside), "__before")).drop("__part", "__pos", "__before")


def carried(df: DataFrame, value: str, *order: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the last value that is not null at or before each row of its group."""
    placed = in_order(df, *_grouped(by), *order)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct("__pos", F.col(value).alias("v")))).alias("__last")
    told = _with_ranges(placed, by, last, found={"__before": F.last("__last.v", ignorenulls=True).over(_earlier(by))})
    inside = Window.partitionBy(*by, "__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "__before")).drop("__part", "__pos", "__before")


def previous(df: DataFrame, value: str, *order: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the value of the row before in its group, null for the first."""
    placed = in_order(df, *_grouped(by), *order)
    table = (F.min("__pos").alias("__first"), F.max(F.struct("__pos", F.col(value).alias("v"))).alias("__end"))
    upto = Window.partitionBy(*by).orderBy("__part")
    told = _with_ranges(placed, by, *table, found={"__low": F.col("__first"), "__before": F.lag("__end.v").over(upto)})
    inside = F.lag(value).over(Window.partitionBy(*by, "__part").orderBy("__pos"))
    return told.withColumn(name, F.when(F.col("__pos") == F.col("__low"), F.col("__before")).otherwise(inside)).drop("__part", "__pos", "__low", "__before")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, from the counts of distinct values; nulls are left out."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    upto = running_sums(distinct, F.col("__v"), sums={"__upto": F.col("__n")}, by=by)
    whole = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__all"))
    joined = upto.join(whole, list(by)) if by else upto.join(F.broadcast(whole))
    at = lambda place: F.max(F.when((place >= F.col("__upto") - F.col("__n")) & (place < F.col("__upto")), F.col("__v")))
    out = []
    for name, share in shares.items():
        place = (F.col("__all") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return joined.groupBy(*by).agg(*out)
