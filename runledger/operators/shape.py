"""Reshaping: derived metrics, pivots, components, derived columns, orders, labels."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.scalars import all_of, alternation, bytes_to_text, mapped, normal_path, text_to_bytes
from runledger.keys import selected


@dataclass(frozen=True)
class Derived:
    """A metric computed from others; expression takes a dict of columns."""

    name: str
    inputs: tuple[str, ...]
    expression: object


def _ratio(a: str, b: str):
    return lambda c: F.try_divide(c[a], c[b])


def _kept(all_: str, lost: str):
    return lambda c: F.try_divide(c[all_] - c[lost], c[all_])


#: Ratios of hardware counters and the counters they need.
COUNTER_METRICS = (
    Derived("cycles_per_insn", ("cpu_cycles", "inst_retired"), _ratio("cpu_cycles", "inst_retired")),
    Derived("ipc", ("cpu_cycles", "inst_retired"), _ratio("inst_retired", "cpu_cycles")),
    Derived("br_pred_miss_rate", ("br_mis_pred", "br_pred"), _ratio("br_mis_pred", "br_pred")),
    Derived("insn_spec_rate", ("inst_retired", "inst_spec"), _ratio("inst_retired", "inst_spec")),
    Derived("eff_backend_ipc", ("inst_retired", "cpu_cycles", "stall_backend"), lambda c: F.try_divide(c["inst_retired"], c["cpu_cycles"] - c["stall_backend"])),
    Derived("l1i_hit_rate", ("l1i_cache", "l1i_cache_refill"), _kept("l1i_cache", "l1i_cache_refill")),
    Derived("l1d_hit_rate", ("l1d_cache", "l1d_cache_refill"), _kept("l1d_cache", "l1d_cache_refill")),
)


def with_derived_metrics(df: DataFrame, keys: Sequence[str], name: str, value: str, metrics: Sequence[Derived] = COUNTER_METRICS) -> DataFrame:
    """Long-form metrics with derived ones appended, each where its group has all inputs.

    keys must tell executions apart: counters that were taken in different ones (counter groups) make no ratio.
    """
    inputs = list(dict.fromkeys(i for m in metrics for i in m.inputs))
    wide = df.where(F.col(name).isin(inputs)).groupBy(*keys).agg(*[F.first(F.when(F.col(name) == i, F.col(value)), ignorenulls=True).alias(f"_i{k}") for k, i in enumerate(inputs)])
    columns = {i: F.col(f"_i{k}") for k, i in enumerate(inputs)}
    rows = F.array(*[F.struct(F.lit(m.name).alias("n"), m.expression(columns).cast("double").alias("v")) for m in metrics])
    derived = wide.select(*keys, F.explode(F.filter(rows, lambda r: r["v"].isNotNull())).alias("_r")).select(*keys, F.col("_r.n").alias(name), F.col("_r.v").alias(value))
    return df.select(*keys, name, F.col(value).cast("double").alias(value)).unionByName(derived)


def sum_over_cpus(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Raw counters of all CPUs added up, before ratios are derived."""
    return df.groupBy(*keys, name).agg(F.sum(value).alias(value))


def pivoted(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, metric: str, how: str = "first") -> DataFrame:
    """One column for each of the values, which are given so that no job has to find them."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(getattr(F, how)(metric))


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def pivot_with_total(df: DataFrame, row: str, column: str, values: Sequence, metric: str, total: str = "Total") -> DataFrame:
    """Sums by row and pivoted column, with a grand-total row on top of the groups."""
    rolled = df.select(F.coalesce(F.col(row), F.lit("")).alias(row), column, metric).rollup(row, column).agg(F.sum(metric).alias("_v"), F.grouping(row).alias("_all"), F.grouping(column).alias("_each"))
    per_row = rolled.where("_each = 0").select(row, column, "_v")
    totals = df.groupBy(column).agg(F.sum(metric).alias("_v")).select(F.lit(total).alias(row), column, "_v")
    return per_row.unionByName(totals).groupBy(row).pivot(column, list(values)).agg(F.first("_v")).na.fill(0)


# -- components ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Component:
    """A name for rows that equal `when` and whose path matches the pattern, where either is given."""

    name: str
    when: Mapping[str, object] = field(default_factory=dict)
    pattern: str | None = None

    def condition(self, path: Column) -> Column:
        parts = [selected(self.when)] if self.when else []
        return all_of([*parts, *([path.rlike(self.pattern)] if self.pattern else [])])


def with_component(df: DataFrame, path: str, components: Sequence[Component], name: str = "component", other: str = "other") -> DataFrame:
    """The last component that matches names a row."""
    matches = [F.when(c.condition(F.col(path)), c.name) for c in reversed(components)]
    return df.withColumn(name, F.coalesce(*matches, F.lit(other)))


def accept_reject(df: DataFrame, path: str, accept: Sequence[str] = (), reject: Sequence[str] = (), when: Sequence[Mapping[str, object]] = ()) -> DataFrame:
    """Keep paths that match some accepted pattern, then drop those that match a rejected one; only for rows that
    any selector of `when` picks, others stay."""
    chosen = F.lit(False) if when else F.lit(True)
    for w in when:
        chosen = chosen | selected(w)
    p = F.coalesce(F.col(path), F.lit(""))
    if accept:
        df = df.where(~chosen | p.rlike(alternation([f"^(?:{a})" for a in accept])))
    return df.where(~chosen | ~p.rlike(alternation([f"^(?:{r})" for r in reject]))) if reject else df


def drop_matching(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col(column), F.lit("")).rlike(alternation(patterns))) if patterns else df


def with_prefixed_path(df: DataFrame, path: str, prefixes: Sequence[tuple[Mapping[str, object], str]], name: str | None = None) -> DataFrame:
    """Paths below the prefix of the first selector that picks the row, then normalised."""
    out = F.col(path)
    for selector, prefix in reversed(list(prefixes)):
        out = F.when(selected(selector), F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(path))).otherwise(out)
    return df.withColumn(name or path, normal_path(out))


def component_rollup(df: DataFrame, component: str, file: str, sums: Sequence[str], baseline: Mapping[str, object], run: Sequence[str]) -> DataFrame:
    """Per run and component: sums, distinct files, and each as a percentage of the baseline run's lines there."""
    rolled = df.groupBy(*run, component).agg(*[F.sum(c).alias(c) for c in sums], F.count_distinct(file).alias("file"))
    lines = df.where(selected(baseline)).groupBy(component).agg(F.sum(sums[0]).alias("_lines"))
    joined = rolled.join(lines, component, "left").withColumn("_lines", F.coalesce("_lines", F.lit(0)))
    percents = [F.try_divide(F.col(c) * 100.0, F.col("_lines")).alias(f"{c}_pct" if c != "file" else "file_pct_of_lines") for c in [*sums, "file"]]
    return joined.select(*run, component, *sums, "file", *percents)


# -- derived columns -----------------------------------------------------------------------------


class References:
    """Column references <name>, resolved through a map."""

    _FORM = re.compile(r"^<(.+)>$")

    def __init__(self, names: Mapping[str, str] | None = None) -> None:
        self.names = dict(names or {})

    def define(self, name: str, column: str) -> None:
        if name in self.names:
            raise ValueError(f"reference defined twice: {name}")
        self.names[name] = column

    def resolve(self, reference: str) -> str:
        m = self._FORM.match(reference)
        if not m:
            return reference
        if m[1] not in self.names:
            raise KeyError(f"undefined reference: {reference}")
        return self.names[m[1]]


def derive(df: DataFrame, name: str, sources: Sequence[str], how: str, references: References | None = None, values: Mapping[str, str] | None = None, separator: str = " ") -> DataFrame:
    """A new column: identity, map, to_bytes_text, from_bytes_text or concat of its sources."""
    if name in df.columns:
        raise ValueError(f"column exists: {name}")
    columns = [F.col((references or References()).resolve(s)) for s in sources]
    ways = {
        "identity": lambda: columns[0],
        "map": lambda: mapped(columns[0].cast("string"), values or {}),
        "to_bytes_text": lambda: bytes_to_text(columns[0]),
        "from_bytes_text": lambda: text_to_bytes(columns[0]),
        "concat": lambda: F.concat_ws(separator, *columns),
    }
    if how not in ways:
        raise ValueError(f"unknown way: {how}")
    if references is not None:
        references.define(name, name)
    return df.withColumn(name, ways[how]())


def columns_like(df: DataFrame, suffix: str | None = None, pattern: str | None = None, types: Sequence[str] | None = None) -> list[str]:
    """Columns by suffix, regular expression and type, all that are given."""
    return [c for c, t in df.dtypes if (suffix is None or c.endswith(suffix)) and (pattern is None or re.search(pattern, c)) and (types is None or t in types)]


def custom_order(df: DataFrame, orders: Mapping[str, Sequence], check: bool = True, ascending: bool = True) -> DataFrame:
    """Sort by several keys, each in the order of its list; a value outside its list is an error."""
    if check and orders:
        outside = df.agg(*[F.max((~F.col(c).isin(list(v)) | F.col(c).isNull()).cast("int")).alias(c) for c, v in orders.items()]).first()
        if bad := [c for c in orders if outside[c]]:
            raise ValueError(f"values outside the order of {bad}")
    keys = [F.array_position(F.array(*[F.lit(x) for x in v]), F.col(c)) for c, v in orders.items()]
    return df.orderBy(*[k.asc() if ascending else k.desc() for k in keys])


def labelled(df: DataFrame, axes: Sequence[str], weights: Mapping[str, Mapping[str, int]] | None = None, labels: Mapping[str, Mapping[str, str]] | None = None, renames: Mapping[str, str] | None = None, name: str = "label", weight: str = "weight") -> DataFrame:
    """Report labels: weights of axis values added up, values relabelled, axes with one value dropped, the rest merged."""
    total = F.lit(0)
    for axis, table in (weights or {}).items():
        found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(axis).cast("string")]
        total = total + F.coalesce(found, F.lit(0))
    varying = df.agg(*[F.count_distinct(a).alias(a) for a in axes]).first()
    kept = sorted(a for a in axes if varying[a] > 1)
    shown = [mapped(F.col(a).cast("string"), (labels or {}).get(a, {})) for a in kept]
    out = df.withColumn(weight, total).withColumn(name, F.concat_ws(" ", *shown) if shown else F.lit(""))
    return out.drop(*[a for a in axes if a not in kept]).withColumnsRenamed(dict(renames or {}))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
