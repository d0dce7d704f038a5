"""Histograms, distributions and bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.quantiles import quantiles


def power_of_two_edges(low: float, high: float) -> list[int]:
    """0 where it is reached, then powers of two that span the range; below zero mirrored."""
    edges: list[int] = []
    if low < 0:
        edges += [-(2**k) for k in range(max(0, math.ceil(math.log2(max(1, -low)))), -1, -1)]
    if low <= 0 <= high:
        edges.append(0)
    if high > 0:
        first = 0 if low <= 1 else math.floor(math.log2(low))
        edges += [2**k for k in range(first, max(first, math.ceil(math.log2(max(1, high)))) + 1)]
    return edges if len(edges) > 1 else [*edges, 2 * edges[0] if edges[0] else 1]


def fixed_edges(low: float, high: float, width: float) -> list[float]:
    first = math.floor(low / width)
    return [width * k for k in range(first, max(first + 1, math.ceil(high / width)) + 1)]


def data_range(df: DataFrame, column: str) -> tuple[float, float]:
    """Least and largest value; one small aggregate."""
    row = df.agg(F.min(column), F.max(column)).first()
    return (0.0, 0.0) if row[0] is None else (float(row[0]), float(row[1]))


def bin_index(x: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of the bin, from 0; the outermost edge is part of its bin; null outside.

    Edges are literals of the plan: a binary search would not pay for some tens of them.
    """
    inside = [F.when((x >= a) & (x < b) if closed == "left" else (x > a) & (x <= b), k) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    last = F.when(x == edges[-1], len(edges) - 2) if closed == "left" else F.when(x == edges[0], 0)
    return F.coalesce(*inside, last)


def histogram(df: DataFrame, groups: Sequence[str], column: str, edges: Sequence[float], closed: str = "left") -> DataFrame:
    """Counts of every group and bin, empty bins too: groups, bin, low, high, count."""
    binned = df.select(*groups, bin_index(F.col(column), edges, closed).alias("bin")).where("bin is not null").groupBy(*groups, "bin").agg(F.count("*").alias("_n"))
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:]))]))
    every = (df.select(*groups).distinct() if groups else df.sparkSession.range(1)).select(*groups, bins.alias("_b")).select(*groups, "_b.bin", "_b.low", "_b.high")
    on = [every[g].eqNullSafe(binned[g]) for g in groups] + [every["bin"] == binned["bin"]]
    return every.join(binned, on, "left").select(*[every[g] for g in groups], every["bin"], "low", "high", F.coalesce("_n", F.lit(0)).alias("count"))


def stacked_histogram(df: DataFrame, group: str, stack: str, column: str, edges: Sequence[float]) -> DataFrame:
    """Counts by group, stack level and bin, with where each stack level begins."""
    counts = histogram(df, [group, stack], column, edges)
    before = Window.partitionBy(group, "bin").orderBy(stack).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))


def cumulative_distribution(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Share of each group's rows up to each value; counts per value first, so that windows see distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*groups).orderBy(column)
    return counts.withColumn("share", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy(*groups)))


def category_shares(df: DataFrame, groups: Sequence[str], category: str) -> DataFrame:
    counts = df.groupBy(*groups, category).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def cumulative_share(df: DataFrame, category: str, order: Sequence[str], value: str) -> DataFrame:
    """Running share of a total over an ordered list of categories."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(category))
    sums = df.where(F.col(category).isin(list(order))).groupBy(category).agg(F.sum(value).alias(value))
    running = Window.partitionBy().orderBy(place)
    return sums.withColumn("share", F.sum(value).over(running) / F.sum(value).over(Window.partitionBy()))


def bands(df: DataFrame, groups: Sequence[str], column: str, inner: float = 0.9) -> DataFrame:
    """Mean, one deviation to each side, and the central interval that holds a share of the values."""
    edges = quantiles(df, groups, {"inner_low": (column, (1 - inner) / 2), "inner_high": (column, (1 + inner) / 2)}).withColumnsRenamed({g: f"_q_{g}" for g in groups})
    stats = df.groupBy(*groups).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    joined = stats.join(edges, [F.col(g).eqNullSafe(F.col(f"_q_{g}")) for g in groups]) if groups else stats.crossJoin(F.broadcast(edges))
    return joined.select(*groups, "mean", (F.col("mean") - F.col("sd")).alias("sd_low"), (F.col("mean") + F.col("sd")).alias("sd_high"), "inner_low", "inner_high")


def conditional_shares(df: DataFrame, groups: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Rows of each group for which each condition holds, as a number and in percent; long form."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("total"), *[F.sum(F.when(c, 1).otherwise(0)).alias(f"_{k}") for k, c in enumerate(conditions.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("category"), F.col(f"_{k}").alias("n")) for k, name in enumerate(conditions)])
    return counts.select(*groups, "total", F.explode(rows).alias("r")).select(*groups, "total", "r.category", "r.n", F.round(F.col("r.n") * 100 / F.col("total"), 2).alias("percent"))
