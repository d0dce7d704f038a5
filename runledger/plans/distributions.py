"""Histograms, distributions, before/after tables, quantile filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import align, histogram
from runledger.plans.registry import query
from runledger.plans.views import table

EDGES = [0, 50_000, 100_000, 200_000, 300_000, 1_000_000]
_BINS = ", ".join(f"({k}, {float(a)}, {float(b)})" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))


@query(
    "price_histogram",
    f"""
    WITH bins(bin, low, high) AS (VALUES {_BINS}), g AS (SELECT DISTINCT o_orderpriority FROM orders)
    SELECT g.o_orderpriority, bin, low::DOUBLE AS low, high::DOUBLE AS high, count(o.o_orderkey) AS count
    FROM g CROSS JOIN bins LEFT JOIN orders o ON o.o_orderpriority = g.o_orderpriority AND o.o_totalprice >= low AND (o.o_totalprice < high OR (bin = {len(EDGES) - 2} AND o.o_totalprice = high)) GROUP BY ALL
    """,
)
def price_histogram(spark, sf_dir):
    return histogram.histogram(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", EDGES)


@query(
    "part_size_powers",
    """
    WITH e AS (SELECT * FROM (VALUES (0, 1.0, 2.0), (1, 2.0, 4.0), (2, 4.0, 8.0), (3, 8.0, 16.0), (4, 16.0, 32.0), (5, 32.0, 64.0)) v(bin, low, high)), g AS (SELECT DISTINCT p_brand FROM part)
    SELECT g.p_brand, bin, low::DOUBLE AS low, high::DOUBLE AS high, count(p.p_partkey) AS count FROM g CROSS JOIN e LEFT JOIN part p ON p.p_brand = g.p_brand AND p_size > low AND p_size <= high OR (p.p_brand = g.p_brand AND bin = 0 AND p_size = low) GROUP BY ALL
    """,
)
def part_size_powers(spark, sf_dir):
    """Bins (a, b] between powers of two that span the data."""
    parts = table(spark, sf_dir, "part")
    low, high = histogram.data_range(parts, "p_size")
    return histogram.histogram(parts, ["p_brand"], "p_size", histogram.power_of_two_edges(low, high), closed="right")


@query(
    "stacked_quantities",
    """
    WITH b AS (SELECT k AS bin, (10 * k)::DOUBLE AS low, (10 * k + 10)::DOUBLE AS high FROM range(0, 5) t(k)),
    every AS (SELECT * FROM (SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem) CROSS JOIN b),
    c AS (SELECT e.l_linestatus, e.l_returnflag, bin, low, high, count(l.l_orderkey) AS count FROM every e LEFT JOIN lineitem l ON l.l_linestatus = e.l_linestatus AND l.l_returnflag = e.l_returnflag AND l_quantity >= low AND (l_quantity < high OR (bin = 4 AND l_quantity = high)) GROUP BY ALL)
    SELECT *, coalesce(sum(count) OVER (PARTITION BY l_linestatus, bin ORDER BY l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c
    """,
)
def stacked_quantities(spark, sf_dir):
    return histogram.stacked_histogram(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", histogram.fixed_edges(0, 50, 10))


@query("part_size_cdf", "SELECT p_brand, p_size, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY p_brand ORDER BY p_size) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY p_brand, p_size")
def part_size_cdf(spark, sf_dir):
    return histogram.cumulative_distribution(table(spark, sf_dir, "part"), ["p_brand"], "p_size").withColumn("share", F.round("share", 6))


@query("segment_shares", "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer GROUP BY c_nationkey, c_mktsegment")
def segment_shares(spark, sf_dir):
    return histogram.category_shares(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment").withColumn("share", F.round("share", 6))


ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("priority_running_share", "SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(count(*)) OVER (ORDER BY o_orderpriority) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderpriority")
def priority_running_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return histogram.cumulative_share(orders.withColumn("n", F.lit(1)), "o_orderpriority", ORDER, "n").withColumn("share", F.round("share", 6))


@query(
    "event_value_bands",
    "SELECT event_type, round(avg(value), 5) AS mean, round(avg(value) - stddev_samp(value), 5) AS sd_low, round(avg(value) + stddev_samp(value), 5) AS sd_high, round(quantile_cont(value, 0.05), 5) AS inner_low, round(quantile_cont(value, 0.95), 5) AS inner_high FROM events GROUP BY ALL",
)
def event_value_bands(spark, sf_dir):
    out = histogram.bands(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


@query(
    "yearly_condition_shares",
    """
    WITH c AS (SELECT year(l_shipdate) AS year, count(*) AS total, sum((l_discount > 0.05)::INT) AS a, sum((l_quantity > 40 AND l_tax < 0.03)::INT) AS b FROM lineitem GROUP BY ALL)
    SELECT year, total, unnest(['discounted', 'large']) AS category, unnest([a, b])::BIGINT AS n, round(unnest([a, b]) * 100 / total, 2) AS percent FROM c
    """,
)
def yearly_condition_shares(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return histogram.conditional_shares(lines, ["year"], {"discounted": F.col("l_discount") > 0.05, "large": (F.col("l_quantity") > 40) & (F.col("l_tax") < 0.03)})


def _first_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    at = F.struct("ts", "event_id")
    groups = events.groupBy("user_id", "day")
    return groups.agg(F.min_by("value", at).alias("value")), groups.agg(F.max_by("value", at).alias("value"))


@query("daily_before_after", "SELECT user_id, ts::DATE::VARCHAR AS day, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS value FROM events GROUP BY ALL")
def daily_before_after(spark, sf_dir):
    """Difference of the last and the first sample of a user and day."""
    before, after = _first_last(spark, sf_dir)
    return align.before_after(before, after, ["user_id", "day"], ["value"]).withColumn("value", F.round("value", 6))


@query(
    "outer_before_after",
    """
    WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS o_custkey, round(coalesce(b.v, 0) - coalesce(a.v, 0), 3) AS v FROM a FULL JOIN b ON a.k = b.k
    """,
)
def outer_before_after(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    out = align.before_after(sums.where("o_orderstatus = 'F'"), sums.where("o_orderstatus = 'O'"), ["o_custkey"], ["v"], how="full")
    return out.withColumn("v", F.round("v", 3))


@query(
    "completed_event_types",
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events)
    SELECT u.user_id, t.event_type, coalesce(c.n, 0) AS n FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type
    """,
)
def completed_event_types(spark, sf_dir):
    """Every user with every event type that occurs."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return align.completed(counts, ["user_id"], ["event_type"], ["n"], fill=0)


@query(
    "value_beside_slice",
    "WITH s AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN v END) OVER (PARTITION BY o_custkey) AS base FROM s",
)
def value_beside_slice(spark, sf_dir):
    most = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    return align.with_slice_value(most, ["o_custkey"], {"o_orderstatus": "F"}, "v", "base")


@query(
    "top_quantile_orders",
    """
    WITH q AS (SELECT *, quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY o_orderpriority) AS e FROM orders)
    SELECT o_orderpriority, o_orderkey, o_totalprice FROM q WHERE o_totalprice >= e QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 20
    """,
)
def top_quantile_orders(spark, sf_dir):
    """A report of the 20 largest of the upper tenth of each priority."""
    return align.top_quantile(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0.9, 20, ["o_orderkey"]).select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("varying_customers", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)")
def varying_customers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return align.varying_keys(orders, ["o_custkey"], "o_orderstatus").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("nonzero_discount_parts", "SELECT l_partkey, sum(l_discount > 0)::BIGINT AS discounted, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING max(abs(l_tax)) > 0) GROUP BY 1")
def nonzero_discount_parts(spark, sf_dir):
    kept = align.nonzero_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_tax")
    return kept.groupBy("l_partkey").agg(F.sum((F.col("l_discount") > 0).cast("long")).alias("discounted"), F.count("*").alias("n"))


@query("members_of_dimension", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) GROUP BY 1")
def members_of_dimension(spark, sf_dir):
    chosen = align.members_of(table(spark, sf_dir, "lineitem"), "l_suppkey", table(spark, sf_dir, "supplier").where("s_nationkey < 10"), "s_suppkey")
    return chosen.groupBy("l_suppkey").agg(F.count("*").alias("n"))
