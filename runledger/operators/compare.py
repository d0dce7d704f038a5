"""Comparison with a baseline: alignment, medians, deltas, overheads, means, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.keys import selected
from runledger.operators import bootstrap
from runledger.operators.quantiles import quantiles
from runledger.session import stored

NAN = float("nan")
TYPES = ("absolute", "delta", "overhead")


def degrees_of_freedom(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with more than one value, in the order given; one small aggregate."""
    if not columns:
        return []
    row = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 1]


def align_baseline(df: DataFrame, metric: str, baseline: Mapping[str, object], keys: Sequence[str], on_missing: str = "raise") -> DataFrame:
    """Adds _baseline: the baseline's value for the same degrees of freedom, and _is_baseline.

    The degrees of freedom are the key columns that vary inside the baseline. Each row must find exactly one baseline
    row; on_missing="null" keeps rows that find none, "check_off" leaves the test of uniqueness out too.
    """
    own = df.where(selected(baseline))
    dof = degrees_of_freedom(own, list(keys))
    right = own.select(*[F.col(c).alias(f"_b_{c}") for c in dof], F.col(metric).alias("_baseline"))
    marked = df.withColumn("_is_baseline", selected(baseline))
    if not dof:
        if on_missing != "check_off" and own.limit(2).count() != 1:
            raise ValueError("a baseline without degrees of freedom must be one row")
        return marked.crossJoin(F.broadcast(right.limit(1)))
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in dof]
    if on_missing != "check_off":
        # Both rules in one aggregate over the distinct keys.
        counts = right.groupBy(*[f"_b_{c}" for c in dof]).agg(F.count("*").alias("_n"))
        key = F.to_json(F.struct(*dof))
        found = marked.select(*dof).distinct().join(counts, on, "left").agg(F.max("_n"), F.max(F.when(F.col("_n") > 1, key)), F.max(F.when(F.col("_n").isNull(), key))).first()
        if found[0] and found[0] > 1:
            raise ValueError(f"several baseline rows for {found[1]}")
        if found[2] and on_missing == "raise":
            raise ValueError(f"no baseline for {found[2]}")
    return marked.join(right, on, "left" if on_missing == "null" else "inner").drop(*[f"_b_{c}" for c in dof])


def _long(wide: DataFrame, keys: Sequence[str], metric: str, columns: Mapping[str, Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One row for each metric type; columns: type -> values, for the names."""
    rows = F.array(*[F.struct(F.lit(t).alias("_metric_type"), *[v.alias(n) for n, v in zip(names, values, strict=True)]) for t, values in columns.items()])
    return wide.select(*keys, "_is_baseline", F.explode(rows).alias("_r")).select(*keys, *[F.col(f"_r.{n}").alias(n) for n in names], F.col("_r._metric_type").alias("_metric_type"), "_is_baseline")


def median_overhead(df: DataFrame, metric: str, baseline: Mapping[str, object], params: Sequence[str], iteration: str | None = "iteration", extra_groupby: Sequence[str] = (), scale: float = 1.0, inverted: bool = False, on_missing: str = "raise") -> DataFrame:
    """Medians per group, their difference from the baseline's, and (median / baseline median - 1) * scale.

    Long form: group columns, metric, _metric_type, _is_baseline. The overhead is NaN where the baseline's median is 0.
    """
    keys = [*params, *([iteration] if iteration else []), *extra_groupby]
    groups = list(dict.fromkeys([*params, *extra_groupby]))
    aligned = align_baseline(df, metric, baseline, keys, on_missing)
    wide = quantiles(aligned, [*groups, "_is_baseline"], {"_m": (metric, 0.5), "_b": ("_baseline", 0.5)})
    m, b, sign = F.col("_m"), F.col("_b"), -scale if inverted else scale
    over = F.when(b != 0, (F.try_divide(m, b) - 1) * sign).otherwise(F.lit(NAN))
    return _long(wide, groups, metric, {"absolute": [m], "delta": [m - b], "overhead": [over]}, [metric])


def mean_overhead(df: DataFrame, metric: str, baseline: Mapping[str, object], params: Sequence[str], scale: float = 1.0, extra_groupby: Sequence[str] = ()) -> DataFrame:
    """Means and sample deviations, with the deviations of deltas and overheads by error propagation.

    Long form with the types <metric>, <metric>_delta and <metric>_overhead and the column <metric>_std. Baseline rows
    have NaN deltas and overheads.
    """
    groups = list(dict.fromkeys([*params, *extra_groupby]))
    stats = df.groupBy(*groups).agg(F.avg(metric).alias("_m"), F.stddev_samp(metric).alias("_s"))
    # A row for each group, looked at twice: stored, so that the table is aggregated once.
    stats = stored(stats, "means").withColumn("_is_baseline", selected(baseline))
    free = [c for c in groups if c not in baseline]
    own = stats.where("_is_baseline").select(*[F.col(c).alias(f"_b_{c}") for c in free], F.col("_m").alias("_bm"), F.col("_s").alias("_bs"))
    joined = stats.join(own, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in free]) if free else stats.crossJoin(F.broadcast(own))
    m, s, bm, bs, base = (F.col(c) for c in ("_m", "_s", "_bm", "_bs", "_is_baseline"))
    delta, spread = m - bm, F.sqrt(s * s + bs * bs)
    over = F.when(bm != 0, F.try_divide(delta, bm) * scale).otherwise(F.lit(NAN))
    part = F.when((delta != 0) & (bm != 0), F.sqrt(F.pow(F.try_divide(spread, delta), 2) + F.pow(F.try_divide(bs, bm), 2))).otherwise(F.lit(NAN))
    none = lambda x: F.when(base, F.lit(NAN)).otherwise(x)
    return _long(joined, groups, metric, {metric: [m, s], f"{metric}_delta": [none(delta), none(spread)], f"{metric}_overhead": [none(over), none(F.abs(over) * part)]}, [metric, f"{metric}_std"])


def overhead(df: DataFrame, metric: str, baseline: Mapping[str, object], params: Sequence[str], iteration: str | None = "iteration", extra_groupby: Sequence[str] = (), scale: float = 1.0, inverted: bool = False, how: str = "median", level: float = bootstrap.LEVEL, on_missing: str = "raise") -> DataFrame:
    """The comparison with intervals: <metric>, <metric>_low, <metric>_high per group and metric type.

    how="mean" gives mean_overhead instead. Intervals are those of an exact bootstrap of the medians.
    """
    if how == "mean":
        return mean_overhead(df, metric, baseline, params, scale, extra_groupby)
    if how != "median":
        raise ValueError(f"unknown statistic: {how}")
    keys = [*params, *([iteration] if iteration else []), *extra_groupby]
    groups = list(dict.fromkeys([*params, *extra_groupby]))
    aligned = align_baseline(df, metric, baseline, keys, on_missing).select(*groups, "_is_baseline", F.col(metric).alias("_v"), F.col("_baseline").alias("_w"))
    out = bootstrap.intervals(aligned, [*groups, "_is_baseline"], "_v", "_w", TYPES, -scale if inverted else scale, level)
    return out.select(*groups, "_is_baseline", F.col("_stat").alias(metric), F.col("_low").alias(f"{metric}_low"), F.col("_high").alias(f"{metric}_high"), "_metric_type")


# -- other statistics ----------------------------------------------------------------------------


def quartile_deltas(df: DataFrame, metric: str, baseline: Mapping[str, object], keys: Sequence[str], run: Sequence[str]) -> DataFrame:
    """mean, median, std, q25, q75 per key and run, each with delta and delta over the baseline run's."""
    quartiles = quantiles(df, [*keys, *run], {"q25": (metric, 0.25), "median": (metric, 0.5), "q75": (metric, 0.75)})
    stats = df.groupBy(*keys, *run).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    quartiles = quartiles.withColumnsRenamed({c: f"_q_{c}" for c in [*keys, *run]})
    stats = stats.join(quartiles, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in [*keys, *run]]).drop(*[f"_q_{c}" for c in [*keys, *run]])
    names = ["mean", "median", "std", "q25", "q75"]
    own = stats.where(selected(baseline)).select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(n).alias(f"_b_{n}") for n in names])
    joined = stats.join(own, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], "left")
    deltas = [(F.col(n) - F.col(f"_b_{n}")).alias(f"{n}_delta") for n in names]
    norms = [F.try_divide(F.col(n) - F.col(f"_b_{n}"), F.col(f"_b_{n}")).alias(f"{n}_norm") for n in names]
    return joined.select(*keys, *run, *names, *deltas, *norms)


def relative_only(df: DataFrame) -> DataFrame:
    """Absolute rows of all, and deltas and overheads of what is not the baseline."""
    return df.where((F.col("_metric_type") == "absolute") | ~F.col("_is_baseline"))


#: Bits per second in each unit.
RATES = {"bps": 1.0, "Kbps": 1e3, "Mbps": 1e6, "Gbps": 1e9, "KiB/s": 8.0 * 1024, "MiB/s": 8.0 * 1024**2, "GiB/s": 8.0 * 1024**3}


def scale_unit(df: DataFrame, columns: Sequence[str], divisor: float) -> DataFrame:
    """Absolute values and deltas in another unit; overheads are ratios and stay."""
    ratio = F.col("_metric_type").endswith("overhead")
    return df.withColumns({c: F.when(ratio, F.col(c)).otherwise(F.col(c) / divisor) for c in columns})


def percent_below(df: DataFrame, metric: str, baseline: Mapping[str, object], keys: Sequence[str]) -> DataFrame:
    """(baseline mean - value) * 100 / baseline mean of every row that is not the baseline's."""
    own = df.where(selected(baseline)).groupBy(*keys).agg(F.avg(metric).alias("_b"))
    rest = df.where(~selected(baseline))
    return rest.join(own, list(keys)).withColumn("overhead", F.try_divide((F.col("_b") - F.col(metric)) * 100, F.col("_b"))).drop("_b")
