"""Parameter matrices, merging of sessions, key columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger import keys
from runledger.plans.registry import query
from runledger.plans.views import table


@query(
    "keep_drop_rules",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' OR o_orderstatus = 'P') AND NOT (o_orderpriority = '5-LOW')",
)
def keep_drop_rules(spark, sf_dir):
    rules = [{"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, {"o_orderstatus": "P"}]
    return keys.keep_drop(table(spark, sf_dir, "orders"), rules, [{"o_orderpriority": "5-LOW"}]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_SESSIONS = """dst AS (SELECT o_orderstatus, o_orderpriority, n_name AS nation, 'd' || o_orderstatus || o_orderpriority || n_name AS dataset_id FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) CROSS JOIN nation),
    src AS (SELECT o_orderstatus, o_orderpriority, o_orderkey AS ord, 's' || o_orderkey AS dataset_id FROM orders)"""


def _sessions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    nations = table(spark, sf_dir, "nation")
    axes = orders.select("o_orderstatus", "o_orderpriority").distinct().join(nations.select(F.col("n_name").alias("nation")))
    destination = axes.withColumn("dataset_id", F.concat(F.lit("d"), "o_orderstatus", "o_orderpriority", "nation"))
    source = orders.select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("dataset_id"))
    return source, destination


_AXES = ["o_orderstatus", "o_orderpriority", "nation"]


@query(
    "session_merge",
    f"WITH {_SESSIONS}, last AS (SELECT o_orderstatus, o_orderpriority, max_by(dataset_id, ord) AS source_id FROM src GROUP BY ALL) SELECT source_id, dst.dataset_id AS destination_id, o_orderstatus, o_orderpriority, nation FROM last JOIN dst USING (o_orderstatus, o_orderpriority) WHERE nation = 'NATION_3'",
)
def session_merge(spark, sf_dir):
    """Runs matched on all axes; of several source runs the last one counts."""
    source, destination = _sessions(spark, sf_dir)
    return keys.merge_by_key(source, destination, _AXES, {"nation": "NATION_3"}, "ord").matched


@query("session_merge_duplicates", f"WITH {_SESSIONS} SELECT o_orderstatus, o_orderpriority, 'NATION_1' AS nation, count(*) AS runs FROM src GROUP BY ALL HAVING count(*) > 1")
def session_merge_duplicates(spark, sf_dir):
    source, destination = _sessions(spark, sf_dir)
    return keys.merge_by_key(source, destination, _AXES, {"nation": "NATION_1"}, "ord").duplicates


@query(
    "moved_runs",
    f"WITH {_SESSIONS}, last AS (SELECT o_orderstatus, o_orderpriority, max(ord) AS ord FROM src GROUP BY ALL) SELECT 'd' || o_orderstatus || o_orderpriority || 'NATION_2' AS dataset_id, l_linenumber AS iteration, sum(l_quantity)::BIGINT AS quantity FROM last JOIN lineitem ON l_orderkey = ord GROUP BY ALL",
)
def moved_runs(spark, sf_dir):
    """The data of each combination's last run, under the id of its destination."""
    source, destination = _sessions(spark, sf_dir)
    merge = keys.merge_by_key(source, destination, _AXES, {"nation": "NATION_2"}, "ord")
    data = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("dataset_id"), F.col("l_linenumber").alias("iteration")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return keys.move_runs(data, merge)


@query(
    "keyed_runs",
    "SELECT o_orderkey AS dataset_id, o_orderstatus, o_orderpriority, l_linenumber AS iteration, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber >= 2 GROUP BY ALL",
)
def keyed_runs(spark, sf_dir):
    """Axes attached to data by run id, the first iterations dropped."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset_id"), "o_orderstatus", "o_orderpriority")
    data = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").alias("iteration")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return keys.with_keys(keys.drop_iterations(data, 2), runs, keys.Keys(("o_orderstatus", "o_orderpriority")))
