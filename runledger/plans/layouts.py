"""Structure layouts over orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import layouts
from runledger.plans.registry import query
from runledger.plans.views import MEMBERS_SQL, members, table
from runledger.session import stored

_ALIAS = """b AS (SELECT owner, name AS alias, byte_offset - 3 AS base, byte_offset + byte_size + 20 AS top FROM members WHERE is_imprecise),
    pairs AS (SELECT m.owner, m.name, m.byte_offset, b.alias FROM members m JOIN b ON b.owner = m.owner AND m.byte_offset < b.top AND m.byte_offset + m.byte_size > b.base AND m.name <> b.alias)"""


def _bounded(spark, sf_dir):
    return members(spark, sf_dir).withColumns({"base": F.col("byte_offset") - 3, "top": F.col("byte_offset") + F.col("byte_size") + 20})


@query("alias_pairs", f"WITH {MEMBERS_SQL}, {_ALIAS} SELECT owner, name, byte_offset, alias FROM pairs")
def alias_pairs(spark, sf_dir):
    """Stored, since the members stand on all sides of the joins."""
    slim = _bounded(spark, sf_dir).select("owner", "name", "byte_offset", "byte_size", "base", "top", "is_imprecise")
    return layouts.alias_pairs(stored(slim, "members"), ["owner"])


@query(
    "annotated_members",
    f"""
    WITH {MEMBERS_SQL}, {_ALIAS}, c AS (SELECT owner, name, row_number() OVER (PARTITION BY owner ORDER BY byte_offset, name) - 1 AS color FROM members WHERE is_imprecise),
    l AS (SELECT p.owner, p.name, p.byte_offset, string_agg(DISTINCT c.color, ',' ORDER BY c.color) AS by_ FROM pairs p JOIN c ON c.owner = p.owner AND c.name = p.alias GROUP BY ALL)
    SELECT m.owner, m.name, m.byte_offset, c.color AS alias_color, coalesce(l.by_, '') AS aliased_by FROM members m LEFT JOIN c ON c.owner = m.owner AND c.name = m.name LEFT JOIN l ON l.owner = m.owner AND l.name = m.name AND l.byte_offset = m.byte_offset
    """,
)
def annotated_members(spark, sf_dir):
    # Stored, since the members stand on all sides of the joins.
    out = layouts.annotated_members(stored(_bounded(spark, sf_dir), "members"), ["owner"])
    return out.select("owner", "name", "byte_offset", F.col("_alias_color").alias("alias_color"), F.array_join(F.col("_aliased_by").cast("array<string>"), ",").alias("aliased_by"))


@query("imprecise_layouts", f"WITH {MEMBERS_SQL} SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT owner FROM members WHERE is_imprecise)")
def imprecise_layouts(spark, sf_dir):
    return layouts.imprecise_layouts(table(spark, sf_dir, "orders"), members(spark, sf_dir), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(
    "layout_summary",
    f"WITH {MEMBERS_SQL} SELECT l_linestatus, count(*) AS members, count(DISTINCT owner) AS layouts, count(array_items) AS arrays, sum(is_pointer::INT)::BIGINT AS pointers, printf('%.2f%%', count(*) * 100.0 / sum(count(*)) OVER ()) AS share FROM members GROUP BY 1",
)
def layout_summary(spark, sf_dir):
    return layouts.layout_summary(members(spark, sf_dir), "l_linestatus", "owner", "array_items", "is_pointer")


@query(
    "struct_totals",
    f"WITH {MEMBERS_SQL} SELECT owner, sum(byte_size)::BIGINT AS size, round(coalesce(sum(array_items), 0) + coalesce(sum(number), 0) / 8.0, 4) AS padding, sum(is_pointer::INT)::BIGINT AS pointers, count(*) AS members, round(sum(is_pointer::INT) / count(*), 6) AS pointer_density FROM members GROUP BY 1",
)
def struct_totals(spark, sf_dir):
    out = layouts.struct_totals(members(spark, sf_dir), ["owner"], "array_items", "number", "is_pointer", "byte_size")
    return out.withColumns({"padding": F.round(F.col("padding").cast("double"), 4), "pointer_density": F.round("pointer_density", 6)})


@query(
    "nested_rollup",
    """
    WITH RECURSIVE n AS (SELECT p_partkey AS id, p_size AS v FROM part), e AS (SELECT (p_partkey // 3)::BIGINT AS parent, p_partkey AS child, 1 + p_size % 3 AS items FROM part WHERE p_partkey // 3 IN (SELECT p_partkey FROM part) AND p_partkey > 2),
    w(node, top, times) AS (SELECT id, id, 1::BIGINT FROM n UNION ALL SELECT node, parent, times * items FROM w JOIN e ON e.child = w.top)
    SELECT top AS id, sum(times * v)::BIGINT AS v FROM w JOIN n ON n.id = w.node GROUP BY 1
    """,
)
def nested_rollup(spark, sf_dir):
    """Sizes of parts with all that is nested in them."""
    parts = table(spark, sf_dir, "part")
    nodes = parts.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    edges = parts.where("p_partkey > 2").select(F.expr("p_partkey div 3").alias("parent"), F.col("p_partkey").alias("child"), (1 + F.col("p_size") % 3).alias("items"))
    edges = edges.join(nodes.select(F.col("id").alias("parent")).hint("merge"), "parent", "left_semi")
    return layouts.rollup_nested(nodes, edges, ["v"])


@query(
    "padding_rows",
    f"""
    WITH {MEMBERS_SQL}, s AS (SELECT owner, name, byte_offset + 2 * (number - 1) AS o, byte_size FROM members), t AS (SELECT owner, max(o + byte_size) + 4 AS total FROM s GROUP BY 1),
    x AS (SELECT s.*, o + byte_size AS e, coalesce(lead(o) OVER (PARTITION BY s.owner ORDER BY o, name), total) AS nxt FROM s JOIN t USING (owner)),
    u AS (SELECT owner, name, o, byte_size, false AS is_padding FROM s UNION ALL SELECT owner, '<pad>', e, nxt - e, true FROM x WHERE nxt > e)
    SELECT owner, name, o::BIGINT AS byte_offset, byte_size::BIGINT AS byte_size, is_padding, row_number() OVER (PARTITION BY owner ORDER BY o, is_padding, name) - 1 AS number FROM u
    """,
)
def padding_rows(spark, sf_dir):
    from pyspark.sql import Window

    spread = members(spark, sf_dir).withColumn("byte_offset", F.col("byte_offset") + 2 * (F.col("number") - 1))
    total = F.max(F.col("byte_offset") + F.col("byte_size")).over(Window.partitionBy("owner")) + 4
    return layouts.with_padding_rows(spread.withColumn("total", total), ["owner"], "byte_offset", "byte_size", "total")


@query(
    "cache_line_growth",
    """
    WITH s AS (SELECT o_custkey, o_orderstatus, floor(sum(o_totalprice) / 1000)::BIGINT AS size, count(*) * 16 AS padding FROM orders GROUP BY 1, 2),
    b AS (SELECT o_custkey, ceil(size / 64)::BIGINT AS base_lines FROM s WHERE o_orderstatus = 'F')
    SELECT o_custkey, o_orderstatus, ceil(size / 64)::BIGINT AS lines, base_lines, ceil(size / 64) > base_lines AS grows, ceil(size / 64) > base_lines AND ceil((size - padding) / 64) <= base_lines AS fixable FROM s JOIN b USING (o_custkey) WHERE o_orderstatus <> 'F'
    """,
)
def cache_line_growth(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.floor(F.sum("o_totalprice") / 1000).alias("size"), (F.count("*") * 16).alias("padding"))
    return layouts.cache_line_growth(sizes, ["o_custkey"], "o_orderstatus", "F")


@query("group_flags", f"WITH {MEMBERS_SQL} SELECT owner, name, bool_or(is_imprecise) OVER (PARTITION BY owner) AS any_is_imprecise, bool_and(is_pointer) OVER (PARTITION BY owner) AS all_is_pointer FROM members")
def group_flags(spark, sf_dir):
    return layouts.group_flags(members(spark, sf_dir), ["owner"], ["is_imprecise", "is_pointer"]).select("owner", "name", "any_is_imprecise", "all_is_pointer")
