"""Runs and their keys: the parameter matrix, key columns, merging of sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.checks import require_columns, require_unique
from runledger.functions.scalars import all_of, any_of

#: Names that an axis can't have.
RESERVED = ("descriptor", "instance", "iteration")


@dataclass(frozen=True)
class Keys:
    """Key columns of run tables."""

    params: tuple[str, ...]
    dataset: str = "dataset_id"
    group: str = "dataset_gid"
    iteration: str = "iteration"
    extra: tuple[str, ...] = field(default=())

    @property
    def key_columns(self) -> list[str]:
        return [self.dataset, *self.params]

    @property
    def key_columns_with_iter(self) -> list[str]:
        return [*self.key_columns, self.iteration]

    @property
    def param_columns_with_iter(self) -> list[str]:
        return [*self.params, self.iteration]


def selected(selector: Mapping[str, object]) -> Column:
    """Rows whose columns equal all values of a selector; a null value selects nulls."""
    return all_of([F.col(k).eqNullSafe(F.lit(v)) for k, v in selector.items()])


def baseline_selector(baseline: str | Mapping[str, object], runs: DataFrame | None = None, name: str = "instance_name") -> dict[str, object]:
    """The selector of a baseline: text is a dataset id; an instance's name becomes its dataset_gid, found in the run table."""
    if isinstance(baseline, str):
        return {"dataset_id": baseline}
    selector = dict(baseline)
    if "instance" in selector:
        wanted = selector.pop("instance")
        found = runs.where(F.col(name) == wanted).agg(F.min("dataset_gid")).first()[0] if runs is not None else None
        if found is None:
            raise ValueError(f"no instance {wanted}")
        selector["dataset_gid"] = found
    return selector


def baseline_slice(df: DataFrame, baseline: str | Mapping[str, object], runs: DataFrame | None = None) -> DataFrame:
    """The rows of a baseline, by the axes that df has; they must be of exactly one dataset_gid."""
    selector = {k: v for k, v in baseline_selector(baseline, runs).items() if k in df.columns}
    chosen = df.where(selected(selector))
    ids = chosen.agg(F.min("dataset_gid").alias("a"), F.max("dataset_gid").alias("z")).first()
    if ids["a"] is None or ids["a"] != ids["z"]:
        raise ValueError(f"{baseline} is not one group of runs")
    return chosen


def keep_drop(df: DataFrame, keep: Sequence[Mapping[str, object]] = (), drop: Sequence[Mapping[str, object]] = ()) -> DataFrame:
    """Keep what any rule of `keep` selects (all, if there is none), then drop what any of `drop` does."""
    if keep:
        df = df.where(any_of([selected(r) for r in keep]))
    return df.where(~any_of([selected(r) for r in drop])) if drop else df


def parameter_matrix(spark: SparkSession, axes: Mapping[str, Sequence], skip: Sequence[Mapping[str, object]] = (), derived: Mapping[str, Sequence[tuple[Mapping[str, object], object]]] | None = None) -> DataFrame:
    """One row per combination of the axes, without skipped ones, with dataset_id.

    derived: per new column, rules (selector, value); the first that matches counts, and a row without one is an error.
    """
    if bad := [a for a in axes if a in RESERVED]:
        raise ValueError(f"reserved names: {bad}")
    out = spark.range(1).select()
    for name, values in axes.items():
        # Axes are a few literals each; their product, the table of runs, needs no join.
        whole = all(isinstance(v, int) and not isinstance(v, bool) for v in values)
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast("bigint") if whole else F.lit(v) for v in values])))
    out = keep_drop(out, drop=skip)
    for name, rules in (derived or {}).items():
        value = F.raise_error(F.lit(f"no rule for {name}")).cast("string")
        for selector, v in reversed(list(rules)):
            value = F.when(selected(selector), F.lit(v)).otherwise(value)
        out = out.withColumn(name, value)
    return out.withColumn("dataset_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in axes]), 256))


def with_keys(data: DataFrame, runs: DataFrame, keys: Keys, iteration: int | None = None) -> DataFrame:
    """Attach the axes of each run by dataset_id; a data column named as an axis is an error."""
    clash = [c for c in data.columns if c in keys.params]
    if clash:
        raise ValueError(f"axes that are also data columns: {clash}")
    require_columns(runs, keys.key_columns)
    if keys.iteration not in data.columns:
        data = data.withColumn(keys.iteration, F.lit(-1 if iteration is None else iteration))
    return data.join(runs.select(*keys.key_columns), keys.dataset)


def drop_iterations(df: DataFrame, n: int, iteration: str = "iteration") -> DataFrame:
    """Without the first n iterations, which number from 0; rows without an iteration (-1) stay."""
    return df.where((F.col(iteration) < 0) | (F.col(iteration) >= n))


def axis_difference(a: Sequence[str], b: Sequence[str]) -> tuple[list[str], list[str]]:
    return sorted(set(a) - set(b)), sorted(set(b) - set(a))


@dataclass
class Merge:
    """matched (source id, destination id), duplicates (axes, count), missing (axes)."""

    matched: DataFrame
    duplicates: DataFrame
    missing: DataFrame


def merge_by_key(source: DataFrame, destination: DataFrame, axes: Sequence[str], extra: Mapping[str, object] | None = None, order: str | None = None) -> Merge:
    """Match runs of two sessions on all axes, by value.

    Source axes must be a subset; `extra` completes them. Several source rows for one destination: the last by `order` wins,
    of equal ones the largest id.
    """
    extra = dict(extra or {})
    have = [c for c in source.columns if c in axes]
    unknown = [c for c in source.columns if c not in axes and c not in ("dataset_id", order)]
    if unknown or set(extra) - set(axes):
        raise ValueError(f"axes that the destination lacks: {sorted({*unknown, *extra} - set(axes))}")
    if both := set(extra) & set(have):
        raise ValueError(f"axes given twice: {sorted(both)}")
    if lacking := set(axes) - set(have) - set(extra):
        raise ValueError(f"axes without a value: {sorted(lacking)}")
    require_unique(destination, list(axes))
    full = source.withColumns({k: F.lit(v) for k, v in extra.items()})
    last = F.col(order) if order else F.col("dataset_id")
    # A maximum is kept up in each task, so no task sees all runs of one combination; nulls are the least.
    chosen = full.groupBy(*axes).agg(F.max(F.struct(last.alias("last"), F.col("dataset_id").alias("source_id"))).alias("_run")).select(*axes, "_run.source_id")
    matched = chosen.join(destination.select(*axes, F.col("dataset_id").alias("destination_id")), list(axes))
    duplicates = full.groupBy(*axes).agg(F.count("*").alias("runs")).where("runs > 1")
    missing = full.select(*axes).distinct().join(destination.select(*axes), list(axes), "left_anti")
    return Merge(matched.select("source_id", "destination_id", *axes), duplicates, missing)


def move_runs(data: DataFrame, merge: Merge) -> DataFrame:
    """Rows of the source session under the ids of the destination."""
    return data.join(merge.matched.select(F.col("source_id").alias("dataset_id"), "destination_id"), "dataset_id").drop("dataset_id").withColumnRenamed("destination_id", "dataset_id")
