"""Structure layouts: members, overlaps, roll-ups, padding, cache lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.intervals import range_join
from runledger.session import stored

SEPARATOR = "::"
CACHE_LINE = 64


def imprecise_layouts(layouts: DataFrame, members: DataFrame, layout_id: str = "id", owner: str = "owner", flag: str = "is_imprecise") -> DataFrame:
    """Layouts that have at least one imprecise member."""
    found = members.groupBy(owner).agg(F.bool_or(flag).alias("_f")).where("_f").select(F.col(owner).alias("_o"))
    return layouts.join(found, F.col(layout_id) == F.col("_o"), "left_semi")


def related(a: Column, b: Column) -> Column:
    """One name is the other or an ancestor of it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit(SEPARATOR))) | F.startswith(b, F.concat(a, F.lit(SEPARATOR)))


def alias_pairs(members: DataFrame, key: Sequence[str], member: str = "name", offset: str = "byte_offset", size: str = "byte_size", base: str = "base", top: str = "top", flag: str = "is_imprecise") -> DataFrame:
    """(key, member, alias): members whose [offset, offset + size) meets the bounds [base, top) of an imprecise member
    of the same structure, other than itself, its ancestors and its descendants.

    Of two ranges that meet, the later start lies in the other one. So two range joins find them, of starts of members in
    bounds and of starts of bounds inside members; pairs that don't meet are not formed, however many members a structure has.
    """
    known = members.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).select(*key, member, offset, size, (F.col(offset) + 1).alias("_after"), (F.col(offset) + F.col(size)).alias("_end"))
    bounds = members.where(F.col(flag)).select(*key, F.col(member).alias("alias"), F.col(base).alias("_base"), F.col(top).alias("_top"))
    later = range_join(known, bounds, offset, "_base", "_top", keys=key)
    earlier = range_join(bounds, known, "_base", "_after", "_end", keys=key)
    pairs = later.unionByName(earlier).where((F.col(offset) < F.col("_top")) & (F.col("_end") > F.col("_base")) & ~related(F.col(member), F.col("alias")))
    return pairs.select(*key, F.col(member), F.col(offset), "alias")


def annotated_members(members: DataFrame, key: Sequence[str], member: str = "name", offset: str = "byte_offset", flag: str = "is_imprecise", **names: str) -> DataFrame:
    """All members with _alias_color (number of an imprecise member, by key and offset) and _aliased_by (sorted numbers)."""
    order = Window.partitionBy(*key).orderBy(offset, member)
    # Numbers begin anew in each structure, so no window spans the table.
    colors = members.where(F.col(flag)).select(*key, F.col(member).alias("alias"), (F.row_number().over(order) - 1).alias("_alias_color"))
    pairs = alias_pairs(members, key, member, offset, flag=flag, **names).join(colors, [*key, "alias"])
    lists = pairs.groupBy(*key, member, offset).agg(F.array_sort(F.collect_set("_alias_color")).alias("_aliased_by"))
    own = colors.withColumnRenamed("alias", member)
    out = members.join(own, [*key, member], "left").join(lists, [*key, member, offset], "left")
    return out.withColumn("_aliased_by", F.coalesce("_aliased_by", F.array().cast("array<int>")))


def group_flags(df: DataFrame, key: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """any_<flag> and all_<flag> of each group beside its rows."""
    stats = df.groupBy(*key).agg(*[x for f in flags for x in (F.bool_or(f).alias(f"any_{f}"), F.bool_and(f).alias(f"all_{f}"))])
    return df.join(stats, list(key))


def layout_summary(members: DataFrame, category: str, layout: str, array_items: str, pointer: str) -> DataFrame:
    """Per category: members, distinct layouts, arrays, pointers, and the share of all members as text."""
    total = members.groupBy().agg(F.count("*").alias("_all"))
    counts = members.groupBy(category).agg(F.count("*").alias("members"), F.count_distinct(layout).alias("layouts"), F.count(array_items).alias("arrays"), F.sum(F.col(pointer).cast("int")).alias("pointers"))
    joined = counts.crossJoin(F.broadcast(total))
    return joined.select(category, "members", "layouts", "arrays", "pointers", F.format_string("%.2f%%", F.col("members") * 100.0 / F.col("_all")).alias("share"))


def struct_totals(members: DataFrame, key: Sequence[str], padding: str, padding_bits: str, pointer: str, size: str) -> DataFrame:
    """Size, padding (bits too, in bytes), pointers and members of each structure, pointers per member."""
    counts = members.groupBy(*key).agg(F.sum(size).alias("size"), (F.coalesce(F.sum(padding), F.lit(0)) + F.coalesce(F.sum(padding_bits), F.lit(0)) / 8.0).alias("padding"), F.sum(F.when(F.col(pointer), 1).otherwise(0)).alias("pointers"), F.count("*").alias("members"))
    return counts.withColumn("pointer_density", F.col("pointers") / F.col("members"))


def rollup_nested(nodes: DataFrame, edges: DataFrame, values: Sequence[str]) -> DataFrame:
    """Totals of structures with all that is nested in them.

    nodes: (id, values); edges: (parent, child, items), a child counting `items` times. Ways from a structure to what it holds
    are found by doubling: those of 1, 2, 4 and so on steps are joined with themselves, so rounds grow with the logarithm of the
    depth. Equal (top, node) ways are added up in each, so they don't grow with the number of paths. A structure that
    holds itself raises. Rounds are stored, so plans stay short. Joins are by merge: compressed files of ways look small enough to
    be broadcast long after their rows are not.
    """
    exact = edges.groupBy(F.col("parent").alias("top"), F.col("child").alias("node")).agg(F.sum("items").cast("long").alias("times"))
    exact = stored(exact, "ways")
    # Ways of up to as many steps as `exact` has.
    ways = exact

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        more = second.select(F.col("top").alias("_middle"), F.col("node").alias("_node"), F.col("times").alias("_times"))
        return first.join(more.hint("merge"), first["node"] == more["_middle"]).select("top", F.col("_node").alias("node"), (F.col("times") * F.col("_times")).alias("times"))

    summed = lambda df: df.groupBy("top", "node").agg(F.sum("times").alias("times"))
    while not exact.isEmpty():
        if not ways.where("top = node").isEmpty():
            raise ValueError("structures that contain each other")
        ways = stored(summed(ways.unionByName(then(exact, ways))), "ways")
        exact = stored(summed(then(exact, exact)), "ways")
    every = ways.unionByName(nodes.select(F.col("id").alias("top"), F.col("id").alias("node"), F.lit(1).cast("long").alias("times")))
    totals = every.join(nodes.hint("merge"), F.col("node") == F.col("id")).groupBy("top").agg(*[F.sum(F.col("times") * F.col(v)).alias(v) for v in values])
    return totals.withColumnRenamed("top", "id")


def with_padding_rows(members: DataFrame, key: Sequence[str], offset: str, size: str, total: str, member: str = "name") -> DataFrame:
    """Members and the gaps between them as rows <pad>, numbered by offset inside each structure."""
    order = Window.partitionBy(*key).orderBy(offset, member)
    ends = members.withColumn("_end", F.col(offset) + F.col(size)).withColumn("_next", F.coalesce(F.lead(offset).over(order), F.col(total)))
    real = members.select(*key, F.col(member), F.col(offset), F.col(size), F.lit(False).alias("is_padding"))
    gaps = ends.where("_next > _end").select(*key, F.lit("<pad>").alias(member), F.col("_end").alias(offset), (F.col("_next") - F.col("_end")).alias(size), F.lit(True).alias("is_padding"))
    every = real.unionByName(gaps)
    return every.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy(offset, "is_padding", member)) - 1)


def cache_line_growth(df: DataFrame, key: Sequence[str], target: str, baseline: str, size: str = "size", padding: str = "padding") -> DataFrame:
    """Cache lines of each structure against the baseline's, and whether taking out padding would win them back."""
    own = df.where(F.col(target) == baseline).select(*key, F.ceil(F.col(size) / CACHE_LINE).alias("base_lines"))
    lines = F.ceil(F.col(size) / CACHE_LINE)
    packed = F.ceil((F.col(size) - F.col(padding)) / CACHE_LINE)
    joined = df.where(F.col(target) != baseline).join(own, list(key))
    return joined.select(*key, target, lines.alias("lines"), "base_lines", (lines > F.col("base_lines")).alias("grows"), ((lines > F.col("base_lines")) & (packed <= F.col("base_lines"))).alias("fixable"))


def layout_view(members: DataFrame, owner: str, member: str, items: str, blocks: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a layout listing: short name, nesting depth, array flag, block label k=v, in the order of the layout."""
    label = F.concat_ws(" ", *[F.concat(F.lit(f"{b}="), F.col(b).cast("string")) for b in blocks])
    short = F.when(F.startswith(F.col(member), F.concat(F.col(owner), F.lit(SEPARATOR))), F.expr(f"substring({member}, length({owner}) + {len(SEPARATOR) + 1})")).otherwise(F.col(member))
    view = members.select("*", short.alias("short_name"), (F.size(F.split(member, SEPARATOR)) - 1).alias("depth"), F.col(items).isNotNull().alias("is_array"), label.alias("block"))
    return view.orderBy(*order)
