"""Ranks, running sums, neighbours and filled values in an order, without one task for a whole key.

Rows are sorted into range partitions, so one key may fill many of them. What a partition begins with is what the ones
before it end with; only one row per partition and key is carried over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import stored


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, list[str]]:
    """df in range partitions, numbered in _range; the names of its order columns."""
    named = {f"_order_{k}": c if isinstance(c, Column) else F.col(c) for k, c in enumerate(order)}
    ranged = df.withColumns(named).repartitionByRange(*keys, *named).withColumn("_range", F.spark_partition_id())
    return stored(ranged, "ranges"), list(named)


def _begun(inside: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what their partition begins with; both have _range and the keys, which may be null."""
    renamed = starts.withColumnsRenamed({k: f"_key_{k}" for k in [*keys, "_range"]})
    return inside.join(renamed, [F.col("_range") == F.col("_key__range"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column | str], following: Mapping[str, str] | None = None, preceding: Mapping[str, str] | None = None, totals: Mapping[str, str] | None = None) -> DataFrame:
    """Adds, under each name, the sum of an expression over the rows before in the order of the row's keys.

    totals: name -> name of a sum, that sum over all rows of the keys.
    following and preceding: name -> column, the column's value in the next row and in the one before, null at the ends. A
    partition gets the first row of the next one that has its key, and the last row of the one before. Rows that are equal in the
    order are put in order by a hash of what is taken from them.
    """
    following, preceding = dict(following or {}), dict(preceding or {})
    named = {f"_sum_{n}": F.expr(c) if isinstance(c, str) else c for n, c in sums.items()}
    taken = sorted({*following.values(), *preceding.values()})
    tie = [F.xxhash64(*taken)] if taken else []
    ranged, by = _ranged(df.withColumns(named), keys, [*order, *tie])
    along = Window.partitionBy("_range", *keys).orderBy(*by)
    ranges = Window.partitionBy(*keys).orderBy("_range")
    before, earlier = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (along, ranges))
    ends = {"_first": F.min_by(F.struct(*taken), F.struct(*by)), "_last": F.max_by(F.struct(*taken), F.struct(*by))} if taken else {}
    ended = ranged.groupBy("_range", *keys).agg(F.lit(1).alias("_some"), *[F.sum(c).alias(c) for c in named], *[c.alias(n) for n, c in ends.items()])
    carried = [F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums]
    if taken:
        carried += [F.lead("_first").over(ranges).alias("_after"), F.lag("_last").over(ranges).alias("_ahead")]
    carried += [F.sum(f"_sum_{of}").over(Window.partitionBy(*keys)).alias(f"_total_{n}") for n, of in (totals or {}).items()]
    starts = ended.select("_range", *keys, *carried)
    inside = ranged.withColumns({n: F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)) for n in sums})
    if taken:
        inside = inside.withColumns({"_next": F.lead(F.struct(*taken)).over(along), "_previous": F.lag(F.struct(*taken)).over(along)})
    told = [(F.col(n) + F.col(f"_start_{n}")).alias(n) for n in sums]
    told += [F.col(f"_total_{n}").alias(n) for n in totals or {}]
    told += [F.coalesce("_next", "_after")[c].alias(n) for n, c in following.items()] + [F.coalesce("_previous", "_ahead")[c].alias(n) for n, c in preceding.items()]
    return _begun(inside, starts, keys).select(*df.columns, *told)


def filled(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], column: str) -> DataFrame:
    """column with nulls replaced by the last value before that is none, in the order of the row's keys."""
    ranged, by = _ranged(df, keys, order)
    until = Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # The last value of a partition and key, by the order; a struct without one is not null by itself.
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*by)))
    ends = ranged.groupBy("_range", *keys).agg(last.alias("_end"))
    starts = ends.select("_range", *keys, F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    inside = ranged.withColumn(column, F.last(column, ignorenulls=True).over(until))
    return _begun(inside, starts, keys).withColumn(column, F.coalesce(column, "_start")).select(*df.columns)


def ranked(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Adds the rank, from 0, of a column's value among its distinct values, in the order of the least `order` of each."""
    firsts = df.groupBy(F.col(column).alias("_v")).agg(F.min(order).alias("_first"))
    numbered = running(firsts.withColumn("_all", F.lit(0)), ["_all"], ["_first", "_v"], {name: F.lit(1)}).select("_v", F.col(name).cast("int").alias(name))
    return df.join(numbered, df[column].eqNullSafe(numbered["_v"])).drop("_v")
