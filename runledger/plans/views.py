"""Run tables over the test tables, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.quantiles import quantiles
from runledger.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Runs by flag and status; the iteration is the line number, the value a median price.
RUNS_SQL = "runs AS (SELECT l_returnflag, l_linestatus, l_linenumber AS iteration, median(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"


def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, since a comparison looks at its runs several times: a few rows each, from all line items."""
    lines = table(spark, sf_dir, "lineitem")
    return stored(quantiles(lines.withColumnRenamed("l_linenumber", "iteration"), ["l_returnflag", "l_linestatus", "iteration"], {"value": ("l_extendedprice", 0.5)}), "runs")


#: Counters in long form: sums over the line items by flag and line number, under the names that counters have.
_COUNTERS = {
    "cpu_cycles": "l_extendedprice",
    "inst_retired": "l_quantity * 100",
    "inst_spec": "l_quantity * 120",
    "br_mis_pred": "l_discount",
    "br_pred": "l_tax + 1",
    "stall_backend": "l_quantity",
    "l1i_cache": "l_quantity * 40",
    "l1i_cache_refill": "l_linenumber",
    "l1d_cache": "l_quantity * 30",
    "l1d_cache_refill": "l_discount * 10",
}
COUNTER_NAMES = tuple(_COUNTERS)
COUNTERS_SQL = f"""counters AS (
    SELECT l_returnflag, iteration, name, value FROM (
        SELECT l_returnflag, l_linenumber AS iteration, {", ".join(f"sum({x})::DOUBLE AS {n}" for n, x in _COUNTERS.items())}
        FROM lineitem GROUP BY ALL
    ) UNPIVOT (value FOR name IN ({", ".join(_COUNTERS)})))"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.operators.shape import unpivoted

    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("iteration")).agg(*[F.sum(F.expr(x)).alias(n) for n, x in _COUNTERS.items()])
    return stored(unpivoted(wide, ["l_returnflag", "iteration"], list(_COUNTERS)), "counters")


#: Intervals of hours by user, with a whole weight.
INTERVALS_SQL = "intervals AS (SELECT user_id, hour(ts)::INT AS low, hour(ts)::INT + 5 + (floor(value)::BIGINT % 7)::INT AS high, floor(value)::BIGINT AS w FROM events)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select("user_id", hour.alias("low"), (hour + 5 + F.floor("value") % 7).cast("int").alias("high"), F.floor("value").cast("long").alias("w"))


#: Structures are orders, members their lines; offsets are running quantities.
MEMBERS_SQL = """members AS (
    SELECT l_orderkey AS owner, l_orderkey::VARCHAR || '::m' || l_linenumber AS name, l_linenumber AS number, l_quantity::BIGINT AS byte_size,
        coalesce(sum(l_quantity::BIGINT) OVER w, 0)::BIGINT AS byte_offset, l_discount > 0.08 AS is_imprecise, l_returnflag = 'R' AS is_pointer,
        CASE WHEN l_tax > 0.06 THEN l_linenumber END AS array_items, l_shipdate, l_linestatus
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1)
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    # One exchange serves both windows.
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = lines.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(
        F.col("l_orderkey").alias("owner"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("::m"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_linenumber").alias("number"),
        F.col("l_quantity").cast("long").alias("byte_size"),
        F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(before), F.lit(0)).alias("byte_offset"),
        (F.col("l_discount") > 0.08).alias("is_imprecise"),
        (F.col("l_returnflag") == "R").alias("is_pointer"),
        F.when(F.col("l_tax") > 0.06, F.col("l_linenumber")).alias("array_items"),
        "l_shipdate",
        "l_linestatus",
    )


#: Successive event types of a user.
STEPS_SQL = "steps AS (SELECT user_id, event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events QUALIFY callee IS NOT NULL)"
