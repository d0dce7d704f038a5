"""Transitions, call graphs, nesting, instruction classes, counters over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import trace
from runledger.plans.registry import query
from runledger.plans.views import STEPS_SQL, table


def _steps(spark, sf_dir):
    return trace.successive(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("transition_counts", f"WITH {STEPS_SQL} SELECT caller, callee, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM steps GROUP BY 1, 2")
def transition_counts(spark, sf_dir):
    return trace.transition_counts(_steps(spark, sf_dir), []).select("caller", "callee", "n", "total")


@query("self_transitions", f"WITH {STEPS_SQL} SELECT user_id, count(*) AS total, sum((caller = callee)::INT)::BIGINT AS self, sum((caller <> callee)::INT)::BIGINT AS cross, round(sum((caller = callee)::INT) / count(*), 6) AS rate FROM steps GROUP BY 1")
def self_transitions(spark, sf_dir):
    """Runs without a self transition stay, with 0."""
    counts = trace.transition_counts(_steps(spark, sf_dir), ["user_id"])
    return trace.self_transitions(counts, ["user_id"]).withColumn("rate", F.round("rate", 6))


@query("call_graph", f"WITH {STEPS_SQL}, e AS (SELECT caller, callee, count(*) AS n FROM steps WHERE caller <> callee GROUP BY 1, 2) SELECT caller, callee, n, round(coalesce(ln(n) / nullif(ln(max(n) OVER ()), 0), 1), 6) AS weight FROM e")
def call_graph(spark, sf_dir):
    return trace.call_graph(trace.transition_counts(_steps(spark, sf_dir), ["user_id"])).withColumn("weight", F.round("weight", 6))


@query("top_transitions", f"WITH {STEPS_SQL}, e AS (SELECT caller, callee, count(*) AS n FROM steps GROUP BY 1, 2) SELECT * FROM e ORDER BY n DESC, caller, callee LIMIT 20")
def top_transitions(spark, sf_dir):
    """A report of the 20 most frequent pairs."""
    return _steps(spark, sf_dir).groupBy("caller", "callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "caller", "callee").limit(20)


@query(
    "nesting_depth",
    """
    WITH s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('login', 'view', 'click') THEN 1 ELSE -1 END AS step, row_number() OVER w AS seq FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, (sum(step) OVER (PARTITION BY user_id ORDER BY seq) - CASE WHEN step > 0 THEN 1 ELSE 0 END)::BIGINT AS depth FROM s)
    SELECT user_id, event_id, seq, depth, lag(seq) OVER (PARTITION BY user_id, depth ORDER BY seq) AS previous FROM d
    """,
)
def nesting_depth(spark, sf_dir):
    """Entering and leaving along a thread, and the previous record of the same depth."""
    enter = F.col("event_type").isin("login", "view", "click")
    return trace.nesting(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], enter).select("user_id", "event_id", "seq", "depth", "previous")


@query(
    "rebased_counters",
    """
    SELECT event_id, round(value - first_value(value) OVER w + 1, 5) AS value, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, event_type) AS rel_us FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id)
    """,
)
def rebased_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return trace.rebased(events, ["user_id", "event_type"], "us", "value", ["event_id"]).select("event_id", F.round("value", 5).alias("value"), "rel_us")


@query("value_relevance", "WITH s AS (SELECT event_type, sum(value) - 100 AS delta FROM events GROUP BY 1) SELECT event_type, round(delta, 4) AS delta, round(abs(delta) / sum(abs(delta)) OVER (), 6) AS relevance FROM s")
def value_relevance(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum("value") - 100).alias("delta"))
    return trace.relevance(sums, "delta").select("event_type", F.round("delta", 4).alias("delta"), F.round("relevance", 6).alias("relevance"))


@query(
    "trigger_window",
    """
    WITH b AS (SELECT (SELECT min(event_id) FROM events WHERE event_type = 'purchase') AS a, (SELECT event_id FROM events WHERE event_type = 'login' ORDER BY event_id LIMIT 1 OFFSET 9) AS z)
    SELECT event_type, count(*) AS n FROM events, b WHERE (a IS NOT NULL AND event_id >= a) AND (z IS NULL OR event_id < z) GROUP BY 1
    """,
)
def trigger_window(spark, sf_dir):
    """Lines from the first purchase to the tenth login."""
    kept = trace.trigger_window(table(spark, sf_dir, "events"), "event_id", "event_type", "purchase", "login", 10)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("function_statistics", "WITH s AS (SELECT ts::DATE AS day, event_type, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS low, round(max(v), 4) AS high, count(*) AS iterations FROM s GROUP BY 1")
def function_statistics(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    out = trace.function_statistics(events, ["day"], ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high")], "iterations")


@query("symbol_instruction_counts", "WITH c AS (SELECT p_brand AS symbol, p_type AS class, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT *, sum(n) OVER (PARTITION BY symbol)::BIGINT AS total FROM c")
def symbol_instruction_counts(spark, sf_dir):
    """Counts by address come first, then the names."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    named = counts.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return trace.per_symbol(named.select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("class"), "n"), "symbol", "class", "n")


@query("function_differences", "WITH c AS (SELECT p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT a.p_brand, a.l_returnflag, a.n, a.n - coalesce(b.n, 0) AS n_diff FROM c a LEFT JOIN c b ON b.l_returnflag = 'A' AND b.p_brand = a.p_brand WHERE a.l_returnflag <> 'A'")
def function_differences(spark, sf_dir):
    """Lines by brand and flag, against the baseline; as in its SQL, a flag has no rows for brands that it lacks."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("k"))
    counts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_returnflag").agg(F.sum("k").alias("n"))
    return trace.baseline_difference(counts, ["p_brand"], "l_returnflag", "A", ["n"], lacking=False)


@query(
    "thread_names",
    """
    WITH p AS (SELECT c_custkey AS pid, max(c_name) AS process FROM customer GROUP BY 1), t AS (SELECT o_custkey AS pid, o_orderkey AS tid, max(o_orderpriority) AS thread FROM orders GROUP BY 1, 2)
    SELECT o_custkey AS pid, o_orderkey AS tid, coalesce(process, 'undetected:' || o_custkey) AS process, coalesce(thread, 'unknown:' || o_orderkey) AS thread FROM orders LEFT JOIN p ON p.pid = o_custkey LEFT JOIN t ON t.pid = o_custkey AND t.tid = o_orderkey
    """,
)
def thread_names(spark, sf_dir):
    """Every order with the names of its customer and of itself."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("tid"), F.col("o_orderpriority").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"))
    return trace.thread_names(customers, orders, orders.drop("name"))


@query(
    "folded_stacks",
    "WITH s AS (SELECT conv_id, string_agg(role, ';' ORDER BY turn) AS stack, count(*) AS samples FROM conversations GROUP BY 1) SELECT stack, sum(samples)::BIGINT AS samples FROM s GROUP BY 1",
)
def folded_stacks(spark, sf_dir):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    stacks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(turns, ";").alias("stack"), F.count("*").alias("samples"))
    return trace.folded(stacks)
