"""Alignment of runs: before and after, completion, cross-sections, quantile filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.keys import selected
from runledger.operators.ordered import filled
from runledger.operators.quantiles import quantiles

#: Distinct names up to which they are broadcast, and of which a task completes a key at a time.
MOST_NAMES = 10_000


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], keep: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """after - before for each key; with how="full" a missing side counts as 0. `keep` comes from before."""
    b = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(c).alias(f"_b_{c}") for c in [*values, *keep]])
    joined = after.select(*keys, *values).join(b, [after[k].eqNullSafe(F.col(f"_b_{k}")) for k in keys], how)
    zero = (lambda c: F.coalesce(c, F.lit(0))) if how == "full" else (lambda c: c)
    named = [F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(k) for k in keys]
    return joined.select(*named, *[(zero(F.col(c)) - zero(F.col(f"_b_{c}"))).alias(c) for c in values], *[F.col(f"_b_{c}").alias(c) for c in keep])


def completed(df: DataFrame, keys: Sequence[str], names: Sequence[str], values: Sequence[str], fill: float | None = None) -> DataFrame:
    """Every key with every combination of names that occurs; new rows have nulls or the fill value.

    Up to MOST_NAMES names are broadcast, after they have been counted. More are dealt into parts of about so many; each
    key asks every part, in tasks by part and key.
    """
    left, right = df.select(*keys).distinct(), df.select(*names).distinct()
    n = right.count()
    if n <= MOST_NAMES:
        every = left.crossJoin(F.broadcast(right))
    else:
        parts, spread = -(-n // MOST_NAMES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = left.withColumn("_spread", F.pmod(F.xxhash64(*keys), F.lit(spread)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = right.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")).withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        every = asked.join(dealt, ["_spread", "_part"]).drop("_spread", "_part")
    data = df.select(*[F.col(c).alias(f"_d_{c}") for c in [*keys, *names]], *values)
    on = [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in [*keys, *names]]
    filled = [F.col(v) if fill is None else F.coalesce(F.col(v), F.lit(fill)) for v in values]
    return every.join(data, on, "left").select(*keys, *names, *[x.alias(v) for x, v in zip(filled, values, strict=True)])


def with_slice_value(df: DataFrame, keys: Sequence[str], selector: Mapping[str, object], value: str, name: str) -> DataFrame:
    """The value of the selected slice beside every row of the same key."""
    return df.withColumn(name, F.max(F.when(selected(selector), F.col(value))).over(Window.partitionBy(*keys)))


def forward_filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Nulls take the last value before them in the order; those before the first value stay null."""
    return filled(df, keys, order, column)


def cross_section(df: DataFrame, selector: Mapping[str, object], complement: bool = False) -> DataFrame:
    chosen = selected(selector)
    return df.where(~chosen) if complement else df.where(chosen)


def top_quantile(df: DataFrame, groups: Sequence[str], column: str, q: float, cap: int, tie: Sequence[str]) -> DataFrame:
    """Rows at or above a group's quantile, at most `cap` of them, largest first (a top-k report)."""
    edge = quantiles(df, groups, {"_edge": (column, q)})
    above = (df.join(edge, list(groups)) if groups else df.crossJoin(F.broadcast(edge))).where(F.col(column) >= F.col("_edge"))
    order = Window.partitionBy(*groups).orderBy(F.col(column).desc(), *tie)
    return above.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n", "_edge")


def nonzero_keys(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Without keys whose value is 0 everywhere."""
    kept = df.groupBy(*keys).agg(F.max(F.abs(F.col(column))).alias("_m")).where("_m > 0").select(*keys)
    return df.join(kept, list(keys), "left_semi")


def varying_keys(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Only keys that have several values."""
    kept = df.groupBy(*keys).agg(F.count_distinct(column).alias("_n")).where("_n > 1").select(*keys)
    return df.join(kept, list(keys), "left_semi")


def members_of(df: DataFrame, column: str, dimension: DataFrame, name: str) -> DataFrame:
    """Rows whose value exists in a dimension table."""
    return df.join(dimension.select(F.col(name).alias("_d")).distinct(), F.col(column) == F.col("_d"), "left_semi")
