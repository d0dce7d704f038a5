"""Coordinates of a drawn table: category positions, group shifts, stack bases, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.checks import require_equal_groups
from runledger.functions.scalars import significant
from runledger.operators.ordered import ranked


def first_appearance(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Number, from 0, of each value in the order in which values first appear. Distinct values alone are ranked."""
    return ranked(df, column, order, name)


def layout_bars(df: DataFrame, x: str, order: str, shift_by: str | None = None, stack_by: str | None = None, value: str | None = None, group_width: float = 0.8, pad: float = 0.9, align: str = "center") -> DataFrame:
    """Adds x_index, shift_index, offset, width and base.

    Groups share group_width of a category's unit; bars take `pad` of their part. Bases are running sums of a bar's
    stack levels below. Categories must have as many rows each.
    """
    require_equal_groups(df, [x])
    out = first_appearance(df, x, order, "x_index")
    if shift_by:
        out = first_appearance(out, shift_by, order, "shift_index")
        groups = df.select(shift_by).distinct().count()
    else:
        out, groups = out.withColumn("shift_index", F.lit(0)), 1
    step = group_width / groups
    shift = F.col("shift_index") * step
    offset = shift - group_width / 2 + step / 2 if align == "center" else shift - group_width / 2
    out = out.withColumns({"offset": offset, "width": F.lit(step * pad)})
    if not stack_by:
        return out.withColumn("base", F.lit(0.0))
    below = Window.partitionBy("x_index", "shift_index").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("base", F.coalesce(F.sum(value).over(below), F.lit(0)).cast("double"))


def point_positions(df: DataFrame, x: str, hue: str, order: str, spread: float = 0.8) -> DataFrame:
    """Number of each point inside its x and hue, and its offset, points side by side in the spread."""
    group = Window.partitionBy(x, hue)
    numbered = df.withColumns({"point": F.row_number().over(group.orderBy(order)) - 1, "points": F.count("*").over(group)})
    return numbered.withColumn("offset", ((F.col("point") + 0.5) / F.col("points") - 0.5) * spread)


def sorted_coordinate(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank of a value among all distinct values, shared by all groups."""
    return ranked(df, column, column, name)


def stripes(df: DataFrame, column: str, name: str = "stripe") -> DataFrame:
    return sorted_coordinate(df, column, "_c").withColumn(name, F.col("_c") % 2).drop("_c")


def bar_labels(df: DataFrame, value: str, high: str | None = None, label: str | None = None) -> DataFrame:
    """Label text (three significant digits, or a column) and its place: the upper bound, or the value."""
    text: Column = F.col(label) if label else significant(F.col(value).cast("double"))
    at = F.coalesce(F.nanvl(F.col(high), F.lit(None).cast("double")), F.col(value)) if high else F.col(value)
    return df.withColumns({"label_text": text, "label_at": at})


def plot_table(df: DataFrame, keep: Column | None = None, derived: dict[str, Column] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The table behind a grid of plots: derived columns, then filter, then order."""
    out = df.withColumns(derived or {})
    out = out.where(keep) if keep is not None else out
    return out.orderBy(*order) if order else out
