"""Components, derived columns, layouts of plots, label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import scalars
from runledger.operators import coords, shape
from runledger.operators.shape import Component
from runledger.plans.registry import query
from runledger.plans.views import table

_COMPONENTS = [Component("metal", pattern="(STEEL|TIN|COPPER|BRASS|NICKEL)"), Component("small", {"p_size": 1}), Component("coated", pattern="^(?=.*PLATED|.*POLISHED).*$")]


@query(
    "part_components",
    """
    SELECT p_partkey, CASE WHEN contains(p_type, 'PLATED') OR contains(p_type, 'POLISHED') THEN 'coated' WHEN p_size = 1 THEN 'small' WHEN regexp_matches(p_type, 'STEEL|TIN|COPPER|BRASS|NICKEL') THEN 'metal' ELSE 'other' END AS component FROM part
    """,
)
def part_components(spark, sf_dir):
    """The last component that matches names a part; patterns may look ahead."""
    return shape.with_component(table(spark, sf_dir, "part"), "p_type", _COMPONENTS).select("p_partkey", "component")


@query("part_first_match", "SELECT CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'standard' WHEN regexp_matches(p_type, 'TIN$') THEN 'tin' ELSE 'other' END AS kind, count(*) AS n FROM part WHERE NOT regexp_matches(p_type, 'BURNISHED|^PROMO') GROUP BY 1")
def part_first_match(spark, sf_dir):
    kept = shape.drop_matching(table(spark, sf_dir, "part"), "p_type", ["BURNISHED", "^PROMO"])
    return kept.groupBy(scalars.first_match(F.col("p_type"), {"standard": "^STANDARD", "tin": "TIN$"}).alias("kind")).agg(F.count("*").alias("n"))


@query("accept_reject_types", "SELECT p_partkey, p_type FROM part WHERE p_brand <> 'Brand#11' OR (regexp_matches(p_type, '^(STANDARD|SMALL)') AND NOT regexp_matches(p_type, '^(?:.*TIN)'))")
def accept_reject_types(spark, sf_dir):
    """Accepted, then rejected patterns, for the parts of one brand."""
    return shape.accept_reject(table(spark, sf_dir, "part"), "p_type", ["STANDARD", "SMALL"], [".*TIN"], [{"p_brand": "Brand#11"}]).select("p_partkey", "p_type")


@query(
    "component_rollup",
    """
    WITH x AS (SELECT l_linestatus, p_brand, l_quantity, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
    b AS (SELECT p_brand, sum(l_quantity) AS lines FROM x WHERE l_linestatus = 'O' GROUP BY 1), r AS (SELECT l_linestatus, p_brand, sum(l_quantity) AS l_quantity, count(DISTINCT l_partkey) AS file FROM x GROUP BY 1, 2)
    SELECT l_linestatus, p_brand, round(l_quantity, 3) AS l_quantity, file, round(l_quantity * 100.0 / nullif(lines, 0), 5) AS l_quantity_pct, round(file * 100.0 / nullif(lines, 0), 5) AS file_pct_of_lines FROM r LEFT JOIN b USING (p_brand)
    """,
)
def component_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = shape.component_rollup(lines, "p_brand", "l_partkey", ["l_quantity"], {"l_linestatus": "O"}, ["l_linestatus"])
    return out.withColumns({"l_quantity": F.round("l_quantity", 3), "l_quantity_pct": F.round("l_quantity_pct", 5), "file_pct_of_lines": F.round("file_pct_of_lines", 5)})


@query(
    "pivot_with_total",
    """
    WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'Total', o_orderstatus, count(*)::BIGINT FROM orders GROUP BY 2)
    SELECT o_orderpriority, coalesce(sum(n) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS F, coalesce(sum(n) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS O, coalesce(sum(n) FILTER (o_orderstatus = 'P'), 0)::BIGINT AS P FROM s GROUP BY 1
    """,
)
def pivot_with_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("n", F.lit(1).cast("long"))
    return shape.pivot_with_total(orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "n")


@query("unpivoted_columns", "SELECT l_returnflag, name, round(sum(value), 3) AS value FROM (SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, l_tax::DOUBLE AS l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax)) GROUP BY 1, 2")
def unpivoted_columns(spark, sf_dir):
    long = shape.unpivoted(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"])
    return long.groupBy("l_returnflag", "name").agg(F.round(F.sum("value"), 3).alias("value"))


@query("normal_url_paths", "SELECT page_id, regexp_extract(url, '([^/?#]*)/*(?:[?#].*)?$', 1) AS last, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages")
def normal_url_paths(spark, sf_dir):
    """Host and last part of each page's path."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", scalars.basename(path).alias("last"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"))


@query(
    "byte_texts",
    """
    WITH s AS (SELECT o_orderkey, floor(o_totalprice * 100)::BIGINT AS n FROM orders)
    SELECT o_orderkey, n, lower(hex(n)) AS hexed, (n & -n)::BIGINT AS low_bit, (n & 4) <> 0 AS bit FROM s
    """,
)
def byte_texts(spark, sf_dir):
    """Numbers as hexadecimal text and their bits; sizes go to text and back."""
    n = F.floor(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))
    whole = scalars.text_to_bytes(F.concat(F.col("n").cast("string"), F.lit("KiB"))) == F.col("n") * 1024
    return rows.where(whole).select("o_orderkey", "n", F.substring(scalars.decimal_to_hex(F.col("n")), 3, 20).alias("hexed"), scalars.lowest_bit(F.col("n")).alias("low_bit"), scalars.has_bit(F.col("n"), 2).alias("bit"))


@query(
    "bar_layout",
    """
    WITH d AS (SELECT o_orderpriority AS x, o_orderstatus AS g, count(*) AS n, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2),
    xi AS (SELECT x, row_number() OVER (ORDER BY min(ord)) - 1 AS x_index FROM d GROUP BY 1), gi AS (SELECT g, row_number() OVER (ORDER BY min(ord)) - 1 AS shift_index FROM d GROUP BY 1)
    SELECT x, g, n, x_index, shift_index, round(shift_index * 0.8 / c - 0.4 + 0.4 / c, 6) + 0.0 AS "offset", round(0.72 / c, 6) AS width, 0.0::DOUBLE AS base
    FROM d JOIN xi USING (x) JOIN gi USING (g) CROSS JOIN (SELECT count(*) AS c FROM gi)
    """,
)
def bar_layout(spark, sf_dir):
    """Bars by category and group, in the order in which they first appear."""
    data = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("g")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("ord"))
    out = coords.layout_bars(data, "x", "ord", shift_by="g")
    return out.select("x", "g", "n", "x_index", "shift_index", F.round("offset", 6).alias("offset"), F.round("width", 6).alias("width"), "base")


@query(
    "stacked_bars",
    """
    WITH d AS (SELECT o_orderstatus AS x, o_orderpriority AS s, count(*) AS n, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2), xi AS (SELECT x, row_number() OVER (ORDER BY min(ord)) - 1 AS x_index FROM d GROUP BY 1)
    SELECT x, s, n, x_index, coalesce(sum(n) OVER (PARTITION BY x ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS base FROM d JOIN xi USING (x)
    """,
)
def stacked_bars(spark, sf_dir):
    data = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("s")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("ord"))
    return coords.layout_bars(data, "x", "ord", stack_by="s", value="n").select("x", "s", "n", "x_index", "base")


@query("striped_names", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1) % 2 AS stripe, dense_rank() OVER (ORDER BY p_size) - 1 AS place FROM part")
def striped_names(spark, sf_dir):
    out = coords.sorted_coordinate(coords.stripes(table(spark, sf_dir, "part"), "p_brand"), "p_size", "place")
    return out.select("p_partkey", "stripe", "place")


@query(
    "point_positions",
    """
    WITH n AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS point, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS points FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_returnflag, point, points, round(((point + 0.5) / points - 0.5) * 0.8, 6) AS "offset" FROM n
    """,
)
def point_positions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("ord", F.struct("l_linenumber", "l_partkey"))
    out = coords.point_positions(lines, "l_orderkey", "l_returnflag", "ord")
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "point", "points", F.round("offset", 6).alias("offset"))


@query(
    "source_line_counts",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, 'license' AS pattern FROM l WHERE regexp_matches(line, '[Ll]icense') UNION ALL SELECT doc_id, 'shout' FROM l WHERE regexp_matches(line, '!!')) SELECT doc_id, pattern, count(*) AS n FROM h GROUP BY 1, 2",
)
def source_line_counts(spark, sf_dir):
    """Lines of each text that match each pattern."""
    patterns = {"license": "[Ll]icense", "shout": "!!"}
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), name) for name, p in patterns.items()]), F.isnotnull)
    return lines.select("doc_id", F.explode(hits).alias("pattern")).groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))


@query(
    "event_property_tags",
    "WITH k AS (SELECT event_id, event_type, unnest(json_keys(props)) AS tag FROM events WHERE props IS NOT NULL) SELECT event_type, tag, count(DISTINCT event_id) AS n, round(count(DISTINCT event_id) * 100.0 / (SELECT count(*) FROM events), 4) AS percent FROM k GROUP BY 1, 2",
)
def event_property_tags(spark, sf_dir):
    """Tags of nested records, how many records have each, and their share of all."""
    events = table(spark, sf_dir, "events")
    total = events.groupBy().agg(F.count("*").alias("_all"))
    tags = events.select("event_id", "event_type", F.explode(F.json_object_keys("props")).alias("tag"))
    counts = tags.groupBy("event_type", "tag").agg(F.count_distinct("event_id").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "tag", "n", F.round(F.col("n") * 100 / F.col("_all"), 4).alias("percent"))


@query(
    "report_labels",
    "WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, o_orderpriority AS priority, n, CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 20 ELSE 0 END + CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END AS weight, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE o_orderpriority END || ' ' || o_orderstatus AS label FROM g",
)
def report_labels(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).withColumn("fixed", F.lit("same"))
    weights = {"o_orderstatus": {"F": 10, "O": 20}, "o_orderpriority": {"1-URGENT": 1}}
    return shape.labelled(groups, ["o_orderstatus", "o_orderpriority", "fixed"], weights, {"o_orderpriority": {"1-URGENT": "urgent"}}, {"o_orderpriority": "priority"})
