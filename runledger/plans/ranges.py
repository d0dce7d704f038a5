"""Range joins, nearest joins, sweeps, windows of iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import intervals as iv
from runledger.plans.registry import query
from runledger.plans.views import INTERVALS_SQL, intervals, table

_BANDS = "bands AS (SELECT p_partkey, floor(p_retailprice * 100)::BIGINT AS low, floor(p_retailprice * 100)::BIGINT + 40 * p_size AS high FROM part)"


@query(
    "range_join_bands",
    f"WITH {_BANDS}, p AS (SELECT l_partkey, floor(l_extendedprice / l_quantity * 100)::BIGINT AS pos, count(*) AS n FROM lineitem GROUP BY ALL) SELECT p.l_partkey, count(*) AS bands, sum(n)::BIGINT AS n FROM p JOIN bands ON pos >= low AND pos < high GROUP BY 1",
)
def range_join_bands(spark, sf_dir):
    """Unit prices in the price bands of parts: how many bands hold a price, and lines by the bands they are in.

    Bands lie over one another, more with every part, so pairs would grow with the square of the input: each price is joined
    with the number of bands over it. Counts by price come before the join.
    """
    bands = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_retailprice") * 100).cast("long").alias("low"), (F.floor(F.col("p_retailprice") * 100) + 40 * F.col("p_size")).cast("long").alias("high"))
    points = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("at")).agg(F.count("*").alias("n"))
    held = iv.covered(points, bands, "at", "low", "high")
    return held.groupBy("l_partkey").agg(F.sum("covers").alias("bands"), F.sum(F.col("n") * F.col("covers")).alias("n"))


@query(
    "range_join_dealt",
    f"WITH {INTERVALS_SQL}, h AS (SELECT user_id, hour(ts)::INT AS pos, count(*) AS n FROM events GROUP BY ALL) SELECT h.user_id, pos, h.n, count(w) AS covers, sum(w)::BIGINT AS weight FROM h LEFT JOIN intervals i ON i.user_id = h.user_id AND pos >= low AND pos < high GROUP BY ALL",
)
def range_join_dealt(spark, sf_dir):
    """The bucketed form, keeping points without a range; by user."""
    points = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("pos")).agg(F.count("*").alias("n"))
    found = iv.range_join(points, intervals(spark, sf_dir), "pos", "low", "high", how="left", bucket=4, keys=["user_id"])
    return found.groupBy("user_id", "pos", "n").agg(F.count("w").alias("covers"), F.sum("w").alias("weight"))


@query(
    "nearest_part_price",
    """
    WITH s AS (SELECT p_retailprice AS start, max(p_partkey) AS k FROM part GROUP BY 1)
    SELECT o_orderkey, p.k AS p_partkey FROM (SELECT o_orderkey, o_totalprice / 100 AS at FROM orders) o ASOF LEFT JOIN s p ON o.at >= p.start
    """,
)
def nearest_part_price(spark, sf_dir):
    """The part of the largest price at or below a hundredth of an order's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    parts = table(spark, sf_dir, "part")
    return iv.nearest_lower(orders, parts, "at", "p_retailprice", ["p_partkey"]).select("o_orderkey", "p_partkey")


@query(
    "resolved_symbols",
    """
    WITH sym AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'shared' ELSE 's' || p_size % 5 END AS space, p_retailprice AS start, max(p_name) AS name FROM part GROUP BY 1, 2),
    pt AS (SELECT o_orderkey, 's' || o_orderkey % 6 AS space, o_totalprice / 100 AS at FROM orders),
    own AS (SELECT pt.*, s.name AS own FROM pt ASOF LEFT JOIN sym s ON pt.space = s.space AND pt.at >= s.start),
    both_ AS (SELECT own.*, s.name AS common FROM own ASOF LEFT JOIN (SELECT * FROM sym WHERE space = 'shared') s ON own.at >= s.start)
    SELECT o_orderkey, coalesce(own, common, 'unknown') AS name, own IS NOT NULL OR common IS NOT NULL AS valid FROM both_
    """,
)
def resolved_symbols(spark, sf_dir):
    """Nearest in the own space, then in the shared one, then unknown."""
    symbols = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 5 == 0, "shared").otherwise(F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string"))).alias("space"), F.col("p_retailprice").alias("start"), F.col("p_name").alias("name"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s"), (F.col("o_orderkey") % 6).cast("string")).alias("space"), (F.col("o_totalprice") / 100).alias("at"))
    return iv.resolve_symbols(points, symbols, "at", "space", "start", "name").select("o_orderkey", "name", "valid")


@query(
    "merged_intervals",
    f"""
    WITH {INTERVALS_SQL}, b AS (SELECT DISTINCT user_id, unnest([low, high]) AS pos FROM intervals),
    e AS (SELECT user_id, pos AS start, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS "end" FROM b)
    SELECT e.user_id, start, "end", sum(w)::BIGINT AS value, count(*) AS covers FROM e JOIN intervals i ON i.user_id = e.user_id AND low <= start AND high >= "end" WHERE "end" IS NOT NULL GROUP BY ALL
    """,
)
def merged_intervals(spark, sf_dir):
    return iv.merge_intervals(intervals(spark, sf_dir), ["user_id"], "low", "high", "w")


@query("equal_intervals", f'WITH {INTERVALS_SQL} SELECT user_id, low AS start, high AS "end", sum(w)::BIGINT AS value FROM intervals GROUP BY ALL HAVING sum(w) <> 0')
def equal_intervals(spark, sf_dir):
    return iv.sum_equal_intervals(intervals(spark, sf_dir), ["user_id"], "low", "high", "w")


_WINDOWS = """markers AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS iteration, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'login')),
    wins AS (SELECT user_id, iteration, ts AS start, nxt AS "end" FROM markers UNION ALL SELECT DISTINCT user_id, 0, NULL, NULL FROM events WHERE user_id NOT IN (SELECT user_id FROM markers))"""


@query("iteration_windows", f'WITH {_WINDOWS} SELECT w.user_id, w.iteration, count(e.event_id) AS n, round(sum(e.value), 4) AS value FROM wins w LEFT JOIN events e ON e.user_id = w.user_id AND (w.start IS NULL OR e.ts >= w.start) AND (w."end" IS NULL OR e.ts < w."end") GROUP BY ALL')
def iteration_windows(spark, sf_dir):
    """Events between the markers of a user."""
    events = table(spark, sf_dir, "events")
    markers = events.where("event_type = 'login'").select("user_id", "ts").distinct()
    wins = iv.iteration_windows(markers, events, ["user_id"], "ts")
    sums = iv.with_iteration(events, wins, ["user_id"], "ts").groupBy("user_id", "iteration").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return wins.select("user_id", "iteration").join(sums, ["user_id", "iteration"], "left").select("user_id", "iteration", F.coalesce("n", F.lit(0)).alias("n"), "value")


@query(
    "size_classes",
    'WITH c AS (SELECT DISTINCT 2 ** k::INT AS class FROM range(1, 7) t(k)) SELECT class::INT AS class, count(*) AS n, sum(p_size)::BIGINT AS total FROM (SELECT p_size, (SELECT min(class) FROM c WHERE class >= p_size) AS class FROM part) WHERE class IS NOT NULL GROUP BY 1',
)
def size_classes(spark, sf_dir):
    """Sizes with the least class that holds them."""
    classes = spark.range(1, 7).select(F.pow(F.lit(2), "id").cast("int").alias("class_limit"))
    out = iv.size_classes(table(spark, sf_dir, "part").select("p_size"), classes, "p_size", "class_limit")
    return out.groupBy("class").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query(
    "region_traffic",
    """
    WITH r AS (SELECT r_name AS name, (r_regionkey * 20000)::BIGINT AS start, (r_regionkey * 20000 + 30000)::BIGINT AS "end" FROM region),
    a AS (SELECT l_partkey AS addr, 'fetch' AS kind, 4::BIGINT AS size FROM lineitem UNION ALL SELECT l_extendedprice::BIGINT, CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END, l_quantity::BIGINT FROM lineitem UNION ALL SELECT l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'read' ELSE 'write' END, 8 FROM lineitem)
    SELECT name, sum((kind = 'fetch')::INT)::BIGINT AS fetch_count, sum(CASE kind WHEN 'fetch' THEN size ELSE 0 END)::BIGINT AS fetch_bytes, sum((kind = 'read')::INT)::BIGINT AS read_count, sum(CASE kind WHEN 'read' THEN size ELSE 0 END)::BIGINT AS read_bytes, sum((kind = 'write')::INT)::BIGINT AS write_count, sum(CASE kind WHEN 'write' THEN size ELSE 0 END)::BIGINT AS write_bytes
    FROM r JOIN a ON addr >= start AND addr < "end" GROUP BY 1
    """,
)
def region_traffic(spark, sf_dir):
    """Memory traffic of overlapping regions; lines as records of a fetch and two accesses."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey").cast("long") * 20000).alias("start"), (F.col("r_regionkey").cast("long") * 20000 + 30000).alias("end"))
    one = F.struct((F.col("l_returnflag") == "R").alias("is_load"), F.round("l_extendedprice").cast("long").alias("addr"), F.round("l_quantity").cast("long").alias("size"))
    two = F.struct((F.col("l_linestatus") == "F").alias("is_load"), F.col("l_suppkey").cast("long").alias("addr"), F.lit(8).cast("long").alias("size"))
    records = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pc"), F.array(one, two, one).alias("mem"))
    return iv.region_traffic(records, regions)
