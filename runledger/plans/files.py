"""Result files of many runs: what the tables hold, written in the form of a tool's report, read back and compared.

Each query derives its files from all rows of a table, one for each run and iteration, in the shared folder. Numbers go
through text as whole numbers or as doubles in full, so the SQL over the tables gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import shape
from runledger.plans import pipelines
from runledger.plans.registry import query
from runledger.plans.views import table
from runledger.session import fresh_path, stored
from runledger.sources import readers, sinks

FLAGS = ["l_returnflag", "l_linestatus"]
BASE = {"l_returnflag": "N", "l_linestatus": "F"}

#: Whole sums over the line items of a run (flag, status) and iteration (line number).
SUMS_SQL = "s AS (SELECT l_returnflag, l_linestatus, l_linenumber AS iteration, count(*) AS n, sum(l_quantity)::BIGINT AS q, sum(round(l_extendedprice)::BIGINT)::BIGINT AS price FROM lineitem GROUP BY ALL)"


def run_id(*columns: str) -> Column:
    """An id in the form of a UUID, from the values of a run's axes."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *columns)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, since the files and the table of runs come from them: a few rows, from all line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy(*FLAGS, F.col("l_linenumber").alias("iteration"))
    whole = lines.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum(F.round("l_extendedprice").cast("long")).alias("price"))
    return stored(whole.withColumn("dataset_id", run_id(*FLAGS)), "sums")


def runs_of(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    return rows.select("dataset_id", *axes).distinct()


def files(rows: DataFrame, content: Column, tag: str) -> str:
    """Files dataset=<id>/iteration=<n>/..., each the content of one row; the glob that reads them."""
    path = fresh_path(rows.sparkSession, tag)
    rows.select(F.col("dataset_id").alias("dataset"), "iteration", content.alias("value")).write.partitionBy("dataset", "iteration").text(path)
    return f"{path}/*/*"


def text_of(form: str, *columns: Column | str) -> Column:
    return F.format_string(form, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def overhead_sql(source: str, groups: Sequence[str], baseline: Mapping[str, str], extra: Sequence[str] = (), scale: float = 1, metric: str = "value", digits: int = 6, constant: Sequence[str] = ()) -> str:
    """Medians of `source` (groups, extra, iteration, value) against the baseline's, in long form.

    constant: further groups, of which the baseline has one alone.
    """
    own = ", ".join(f"r.{c}" for c in [*groups, *extra, *constant])
    names = ", ".join([*groups, *extra, *constant])
    base = " AND ".join(f"b.{k} = '{v}'" for k, v in baseline.items())
    same = " AND ".join(["b.iteration = r.iteration", *[f"b.{c} = r.{c}" for c in extra]])
    return f"""SELECT {names}, t AS _metric_type, _is_baseline, round(CASE t WHEN 'absolute' THEN m WHEN 'delta' THEN m - b ELSE CASE WHEN b <> 0 THEN (m / b - 1) * {scale} END END, {digits}) AS {metric}
    FROM (SELECT {own}, median(r.value) AS m, median(b.value) AS b, bool_and({base.replace("b.", "r.")}) AS _is_baseline FROM {source} r JOIN {source} b ON {base} AND {same} GROUP BY ALL)
    CROSS JOIN (VALUES ('absolute'), ('delta'), ('overhead')) v(t)"""


def point(rows: DataFrame, metric: str, digits: int = 6) -> DataFrame:
    """Without the bootstrap's bounds, which SQL can't repeat."""
    return rows.drop(f"{metric}_low", f"{metric}_high").withColumn(metric, F.round(F.nanvl(F.col(metric), F.lit(None).cast("double")), digits))




# -- timings -------------------------------------------------------------------------------------


@query("timing_files", f"WITH {SUMS_SQL}, d AS (SELECT *, q / 1000.0 AS value FROM s), long AS ({overhead_sql('d', FLAGS, BASE, metric='times')}) SELECT * FROM long WHERE _metric_type = 'absolute' OR NOT _is_baseline")
def timing_files(spark, sf_dir):
    """real, user and sys lines of every run and iteration, compared by their medians."""
    rows = sums(spark, sf_dir)
    path = files(rows, text_of("real %s\nuser %s\nsys %s", F.col("q") / 1000, F.col("price") / 1000, F.col("n") / 100), "time")
    return point(pipelines.timing_comparison(spark, path, runs_of(rows, FLAGS), BASE, FLAGS), "times")


@query("hyperfine_files", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, q / 8.0 AS times, price / 4.0 AS \"user\", n / 2.0 AS sys FROM s")
def hyperfine_files(spark, sf_dir):
    rows = sums(spark, sf_dir)
    one = F.struct(F.array(F.col("q") / 8).alias("times"), F.array(F.lit(0)).alias("exit_codes"), (F.col("price") / 4).alias("user"), (F.col("n") / 2).alias("system"))
    path = files(rows, F.to_json(F.struct(F.array(one).alias("results"))), "hyperfine")
    return pipelines.with_runs(readers.read_hyperfine(spark, path), runs_of(rows, FLAGS)).select(*FLAGS, "iteration", "times", "user", "sys")


# -- network -------------------------------------------------------------------------------------


def _iperf(spark, sf_dir):
    rows = sums(spark, sf_dir)
    side = lambda k: F.struct((F.col("n") / k).alias("seconds"), (F.col("q") * k).alias("bytes"), (F.col("price") * k).cast("double").alias("bits_per_second"))
    total = F.struct((F.col("n") / 16).alias("jitter_ms"), F.col("q").alias("packets"), F.col("n").alias("lost_packets"), (F.col("n") / 32).alias("lost_percent"))
    start = F.struct(F.lit(4096).alias("sndbuf_actual"), F.lit(8192).alias("rcvbuf_actual"), F.struct(F.lit(128).alias("blksize")).alias("test_start"))
    end = F.struct(side(4).alias("sum_sent"), side(2).alias("sum_received"), total.alias("sum"))
    return rows, files(rows, F.to_json(F.struct(start.alias("start"), end.alias("end"))), "iperf")


@query(
    "iperf_files",
    f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, side, n / k AS seconds, (q * k)::BIGINT AS bytes, (price * k)::DOUBLE AS bits_per_second, n / 16 AS jitter_ms, q AS packets, n AS lost_packets, n / 32 AS lost_percent, 4096::BIGINT AS sndbuf, 8192::BIGINT AS rcvbuf, 128::BIGINT AS blksize FROM s CROSS JOIN (VALUES ('sender', 4), ('receiver', 2)) v(side, k)",
)
def iperf_files(spark, sf_dir):
    """Both sides of every report, with the losses of datagrams."""
    rows, path = _iperf(spark, sf_dir)
    return pipelines.with_runs(readers.read_iperf(spark, path, udp=True), runs_of(rows, FLAGS)).drop("dataset_id")


@query("throughput_files", f"WITH {SUMS_SQL}, d AS (SELECT *, price * 2 AS value FROM s), long AS ({overhead_sql('d', FLAGS, BASE, metric='v', digits=12)}) SELECT l_returnflag, l_linestatus, _metric_type, _is_baseline, round(CASE WHEN _metric_type = 'overhead' THEN v ELSE v / 1e6 END, 6) AS bits_per_second FROM long WHERE _metric_type = 'absolute' OR NOT _is_baseline")
def throughput_files(spark, sf_dir):
    """The receiver's throughput in megabits; overheads stay ratios."""
    rows, path = _iperf(spark, sf_dir)
    return point(pipelines.throughput_summary(spark, path, runs_of(rows, FLAGS), BASE, FLAGS), "bits_per_second")


def _qps(spark, sf_dir):
    rows = sums(spark, sf_dir)
    named = {"qps": F.col("q") / 4, "messageCount": F.col("n"), "elapsedTime": F.col("n") / 8, **{f"latency{p}": F.col("price") / k for k, p in enumerate(("50", "90", "95", "99", "999"), 1)}}
    # Only one of the flags has requests of a given size.
    payload = F.when(F.col("l_returnflag") == "A", F.struct(F.lit(64).alias("reqSize"), F.lit(128).alias("respSize")))
    scenario = F.struct(F.struct(F.struct(payload.alias("simpleParams")).alias("payloadConfig")).alias("clientConfig"))
    return rows, files(rows, F.to_json(F.struct(F.struct(*[c.cast("double").alias(k) for k, c in named.items()]).alias("summary"), scenario.alias("scenario"))), "qps")


@query(
    "rpc_files",
    f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, q / 4 AS qps, n::DOUBLE AS message_count, n / 8 AS elapsed_time, price / 1 AS latency50, price / 2 AS latency90, price / 3 AS latency95, price / 4 AS latency99, price / 5 AS latency999, CASE l_returnflag WHEN 'A' THEN 64 ELSE 0 END::BIGINT AS req_size, CASE l_returnflag WHEN 'A' THEN 128 ELSE 0 END::BIGINT AS resp_size FROM s",
)
def rpc_files(spark, sf_dir):
    """Fields in snake case; sizes that are not given are 0."""
    rows, path = _qps(spark, sf_dir)
    return pipelines.with_runs(readers.read_qps(spark, path), runs_of(rows, FLAGS)).drop("dataset_id")


@query(
    "rpc_latency",
    f"WITH {SUMS_SQL}, d AS (SELECT *, price / 2 / 1000 AS value, CASE l_returnflag WHEN 'A' THEN 64 ELSE 0 END::BIGINT AS req_size, CASE l_returnflag WHEN 'A' THEN 128 ELSE 0 END::BIGINT AS resp_size FROM s) {overhead_sql('d', FLAGS, BASE, metric='latency90', constant=['req_size', 'resp_size'])}",
)
def rpc_latency(spark, sf_dir):
    """Latencies in milliseconds, by the size of requests."""
    rows, path = _qps(spark, sf_dir)
    return point(pipelines.rpc_summary(spark, path, runs_of(rows, FLAGS), BASE, FLAGS, "latency90"), "latency90")


@query("store_files", f"WITH {SUMS_SQL}, d AS (SELECT l_returnflag, l_linestatus, iteration, q / 2 AS value FROM s), long AS ({overhead_sql('d', FLAGS, BASE, metric='requests_per_second')}) SELECT * FROM long WHERE _metric_type = 'absolute' OR NOT _is_baseline")
def store_files(spark, sf_dir):
    rows = sums(spark, sf_dir)
    path = files(rows, text_of("requests_per_second,latency_ms,errors,connections\n%s,%s,0,%s", F.col("q") / 2, F.col("price") / 64, F.col("n")), "redis")
    return point(pipelines.store_summary(spark, path, runs_of(rows, FLAGS), BASE, FLAGS), "requests_per_second")


@query("store_errors", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, q / 2 AS requests_per_second, (n % 2)::BIGINT AS errors, n % 2 <> 0 AS has_errors FROM s")
def store_errors(spark, sf_dir):
    """Which reports have a row with errors."""
    rows = sums(spark, sf_dir)
    path = files(rows, text_of("requests_per_second,latency_ms,errors,connections\n%s,1.5,%s,8", F.col("q") / 2, F.col("n") % 2), "redis")
    return pipelines.with_runs(readers.read_redis(spark, path), runs_of(rows, FLAGS)).select(*FLAGS, "iteration", "requests_per_second", "errors", "has_errors")


def _wrk(spark, sf_dir):
    rows = sums(spark, sf_dir).withColumn("request_size", F.when(F.col("l_linestatus") == "F", 512).otherwise(1024))
    percentiles = ("50", "90", "95", "99", "999")
    latency = {"min": "n", "max": "price", "mean": "q", "std": "n", **{f"percentile{p}": "q" for p in percentiles}}
    parts = [F.struct((F.col("n") * 1000).cast("double").alias("duration"), F.col("q").alias("requests"), F.col("price").alias("bytes")).alias("summary"), F.struct((F.col("n") % 3).alias("status"), F.lit(7).alias("read")).alias("errors"), F.struct(*[F.col(c).cast("double").alias(k) for k, c in latency.items()]).alias("latency")]
    return rows, files(rows, F.to_json(F.struct(F.concat(F.lit("load_"), F.col("request_size").cast("string"), F.lit("b")).alias("scenario"), *parts)), "wrk")


@query(
    "http_files",
    f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, CASE l_linestatus WHEN 'F' THEN 512 ELSE 1024 END::BIGINT AS request_size, q AS requests, price AS bytes, n % 3 AS errors, q::DOUBLE AS latency_percentile95, q::DOUBLE AS latency_percentile999, round(q * 1e6 / (n * 1000), 6) AS requests_per_second FROM s",
)
def http_files(spark, sf_dir):
    """Summaries of every report; errors are failed responses."""
    rows, path = _wrk(spark, sf_dir)
    data = pipelines.with_runs(readers.read_wrk(spark, path), runs_of(rows, FLAGS))
    return data.select(*FLAGS, "iteration", "request_size", "requests", "bytes", "errors", "latency_percentile95", "latency_percentile999", F.round("requests_per_second", 6).alias("requests_per_second"))


@query(
    "http_load",
    f"""WITH {SUMS_SQL}, m AS (SELECT l_returnflag, CASE l_linestatus WHEN 'F' THEN 512 ELSE 1024 END::BIGINT AS request_size, avg(q * 1e6 / (n * 1000)) AS v FROM s GROUP BY ALL)
    SELECT m.l_returnflag, request_size, round(m.v, 6) AS requests_per_second, round((b.v - m.v) * 100 / b.v, 6) AS overhead FROM m JOIN m b USING (request_size) WHERE b.l_returnflag = 'N' AND m.l_returnflag <> 'N'""",
)
def http_load(spark, sf_dir):
    """Means of the other runs in percent below the baseline's, by request size."""
    rows, path = _wrk(spark, sf_dir)
    below, _ = pipelines.http_load(spark, path, runs_of(rows, ["l_returnflag"]), {"l_returnflag": "N"}, ["l_returnflag"])
    return below.select("l_returnflag", "request_size", *[F.round(c, 6).alias(c) for c in ("requests_per_second", "overhead")])


@query(
    "network_metrics",
    f"WITH {SUMS_SQL}, d AS (SELECT l_returnflag, l_linestatus, iteration, 'throughput' AS metric, q / 2 AS value FROM s UNION ALL SELECT l_returnflag, l_linestatus, iteration, 'local_cpu_util', n / 4 FROM s) {overhead_sql('d', FLAGS, BASE, ['metric'])}",
)
def network_metrics(spark, sf_dir):
    """Chosen fields of tables below a banner, under names in lower case."""
    rows = sums(spark, sf_dir)
    path = files(rows, text_of("MIGRATED STREAM TEST\nElapsed,THROUGHPUT,LOCAL_CPU_UTIL\n10,%s,%s\n", F.col("q") / 2, F.col("n") / 4), "netperf")
    return point(pipelines.network_metrics(spark, path, runs_of(rows, FLAGS), ["THROUGHPUT", "LOCAL_CPU_UTIL"], BASE, FLAGS), "value")


# -- counters ------------------------------------------------------------------------------------


def _counter_files(spark, sf_dir):
    rows = sums(spark, sf_dir)
    # Two samples of two processors.
    content = text_of("# s/0/CPU_CYCLES s/1/CPU_CYCLES s/0/INST_RETIRED s/1/INST_RETIRED\n%s %s %s %s\n%s 0 %s 1", "price", "n", "q", "n", "n", "n")
    return rows, files(rows, content, "counters")


@query("counter_files", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, cpu, name, (CASE name WHEN 'cpu_cycles' THEN CASE cpu WHEN 0 THEN price + n ELSE n END ELSE CASE cpu WHEN 0 THEN q + n ELSE n + 1 END END)::DOUBLE AS value FROM s CROSS JOIN (VALUES (0), (1)) c(cpu) CROSS JOIN (VALUES ('cpu_cycles'), ('inst_retired')) v(name)")
def counter_files(spark, sf_dir):
    """Samples added up, by processor."""
    rows, path = _counter_files(spark, sf_dir)
    return pipelines.with_runs(readers.read_counters(spark, path), runs_of(rows, FLAGS)).drop("dataset_id")


@query(
    "counter_file_summary",
    f"""WITH {SUMS_SQL}, c AS (SELECT *, price + 2 * n AS cy, q + 2 * n + 1 AS ins FROM s),
    d AS (SELECT l_returnflag, l_linestatus, iteration, unnest(['cpu_cycles', 'inst_retired', 'cycles_per_insn', 'ipc']) AS name, unnest([cy::DOUBLE, ins::DOUBLE, cy / ins, ins / cy]) AS value FROM c), long AS ({overhead_sql('d', FLAGS, BASE, ['name'])}) SELECT * FROM long WHERE _metric_type = 'delta'""",
)
def counter_file_summary(spark, sf_dir):
    """Counters of all processors added up, ratios derived, differences from the baseline."""
    rows, path = _counter_files(spark, sf_dir)
    return point(pipelines.counter_summary(spark, path, runs_of(rows, FLAGS), BASE, FLAGS, "delta", ["cpu_cycles", "inst_retired"], [0, 1]), "value")


@query("numbered_counter_files", "SELECT l_linenumber - 1 AS iteration, 'cpu_cycles' AS name, sum(l_quantity) AS value FROM lineitem GROUP BY 1")
def numbered_counter_files(spark, sf_dir):
    """Files that are numbered from 1 in their folders' names, as iterations from 0."""
    path = fresh_path(spark, "series")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("q"))
    lines.select(F.col("l_linenumber").alias("run"), text_of("# p/CPU_CYCLES\n%s", "q").alias("value")).write.partitionBy("run").text(path)
    return readers.read_counters_series(spark, f"{path}/*", pattern=r"/run=([0-9]+)/").select("iteration", "name", "value")


@query("counters_per_request", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, name, round(value / n, 6) AS per_message, CASE l_returnflag WHEN 'A' THEN round(value / (n * 192), 6) END AS per_byte FROM (SELECT *, 'cpu_cycles' AS name, price + 2 * n AS value FROM s UNION ALL SELECT *, 'inst_retired', q + 2 * n + 1 FROM s)")
def counters_per_request(spark, sf_dir):
    """Counters of a run and iteration by its messages, and by their bytes where sizes are known."""
    rows, path = _counter_files(spark, sf_dir)
    _, rates = _qps(spark, sf_dir)
    runs = runs_of(rows, FLAGS)
    counts = shape.sum_over_cpus(pipelines.with_runs(readers.read_counters(spark, path), runs), ["dataset_id", *FLAGS, "iteration"], "name", "value")
    out = pipelines.counters_per_request(counts, pipelines.with_runs(readers.read_qps(spark, rates), runs))
    return out.select(*FLAGS, "iteration", "name", *[F.round(c, 6).alias(c) for c in ("per_message", "per_byte")])


@query(
    "request_metrics",
    f"""
    WITH {SUMS_SQL}, c AS (SELECT *, (price + 2 * n)::DOUBLE AS cycles, (q + 2 * n + 1)::DOUBLE AS insns FROM s),
    m AS (SELECT l_returnflag, l_linestatus, unnest(['cpu_cycles_per_message', 'inst_retired_per_message', 'cpu_cycles_per_byte', 'inst_retired_per_byte', 'cycles_per_insn', 'ipc']) AS metric,
        unnest([cycles / n, insns / n, CASE l_returnflag WHEN 'A' THEN cycles / (n * 192) END, CASE l_returnflag WHEN 'A' THEN insns / (n * 192) END, cycles / insns, insns / cycles]) AS value FROM c)
    SELECT l_returnflag, l_linestatus, metric, round(avg(value), 6) AS value FROM m WHERE value IS NOT NULL GROUP BY ALL
    """,
)
def request_metrics(spark, sf_dir):
    """Counter ratios, and counters by messages and bytes, of the runs that a load generator measured; means over iterations."""
    rows, path = _counter_files(spark, sf_dir)
    _, rates = _qps(spark, sf_dir)
    runs = runs_of(rows, FLAGS)
    counts = shape.sum_over_cpus(pipelines.with_runs(readers.read_counters(spark, path), runs), ["dataset_id", *FLAGS, "iteration"], "name", "value")
    out = pipelines.request_metrics(stored(counts, "counters"), pipelines.with_runs(readers.read_qps(spark, rates), runs), FLAGS)
    return out.withColumn("value", F.round("value", 6))


# -- stacks, traces ------------------------------------------------------------------------------

_REPORT = "WITH c AS (SELECT o_orderstatus, o_orderpriority[1:1] AS p, count(*) AS n FROM orders GROUP BY 1, 2)"


def _call_graphs(spark, sf_dir):
    """A report for each status: a root, a child for each priority, and a leaf below every one."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count("*").alias("n"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("p", "n"))), lambda x: F.format_string("  20.0%% [%s] child_%s\n    10.0%% [%s] leaf", (x["n"] * 2).cast("string"), x["p"], x["n"].cast("string")))
    total = F.sum("n").cast("string")
    text = F.concat(F.format_string("@ CPU_CYCLES [%s samples]\n100.0%% [%s] main\n", total, total), F.array_join(entries, "\n"))
    rows = counts.groupBy("o_orderstatus").agg(text.alias("content")).withColumns({"dataset_id": run_id("o_orderstatus"), "iteration": F.lit(0)})
    return files(rows, F.col("content"), "stacks")


@query("call_graph_files", f"{_REPORT} SELECT 'leaf;child_' || p || ';main' AS stack, sum(n)::BIGINT AS samples FROM c GROUP BY 1")
def call_graph_files(spark, sf_dir):
    """One stack for each leaf of a report, the leaf first, added up over reports."""
    return pipelines.folded_stacks(spark, _call_graphs(spark, sf_dir))


@query("folded_text", f"{_REPORT} SELECT 'leaf;child_' || p || ';main ' || sum(n)::BIGINT AS value FROM c GROUP BY p")
def folded_text(spark, sf_dir):
    """The same as lines for external viewers."""
    path = fresh_path(spark, "folded")
    sinks.write_folded(pipelines.folded_stacks(spark, _call_graphs(spark, sf_dir)), path)
    return spark.read.text(path)


@query(
    "sample_changes",
    """
    WITH c AS (SELECT o_orderpriority, month(o_orderdate) % 4 AS iteration, o_orderstatus AS sysctl_name, count(*) AS n, sum(o_custkey)::BIGINT AS later FROM orders GROUP BY ALL),
    k AS (SELECT DISTINCT o_orderpriority, iteration FROM c), m AS (SELECT DISTINCT sysctl_name FROM c)
    SELECT k.o_orderpriority, k.iteration, m.sysctl_name, (c.later - c.n)::DOUBLE AS value FROM k CROSS JOIN m LEFT JOIN c ON c.o_orderpriority = k.o_orderpriority AND c.iteration = k.iteration AND c.sysctl_name = m.sysctl_name
    """,
)
def sample_changes(spark, sf_dir):
    """name=value samples before and after; every run gets every name."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.month("o_orderdate") % 4).alias("iteration"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("later"))
    one = lambda c: F.array_join(F.array_sort(F.collect_list(F.concat("o_orderstatus", F.lit("="), F.col(c).cast("string")))), "\n").alias(c)
    rows = stored(counts.groupBy("o_orderpriority", "iteration").agg(one("n"), one("later")).withColumn("dataset_id", run_id("o_orderpriority")), "samples")
    before, after = files(rows, F.concat("n", F.lit("\nkern.version=9=x")), "before"), files(rows, F.col("later"), "after")
    runs = runs_of(rows, ["o_orderpriority"])
    out = pipelines.before_after_samples(spark, before, after, runs)
    return out.join(runs, "dataset_id").select("o_orderpriority", "iteration", "sysctl_name", "value")


_PARTS_SQL = "steps AS (SELECT hour(ts) // 6 AS part, dayofmonth(ts) % 5 AS iteration, event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events QUALIFY callee IS NOT NULL)"


def _transition_rates(spark, sf_dir):
    from pyspark.sql import Window

    follows = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.floor(F.hour("ts") / 6).cast("int").alias("part"), (F.dayofmonth("ts") % 5).alias("iteration"), "event_id", F.col("event_type").alias("caller"), F.lead("event_type").over(follows).alias("callee")).where("callee is not null").withColumn("dataset_id", run_id("part"))
    line = text_of("%s 0.1 RTLD: c18n: %s -> %s at [%s] call", "event_id", "caller", "callee", F.length("callee"))
    path = files(steps, line, "trace")
    return pipelines.transition_frequency(spark, path, runs_of(steps, ["part"]), ["part"])


@query(
    "transition_files",
    f"WITH {_PARTS_SQL}, c AS (SELECT part, iteration, caller, callee, count(*) AS n FROM steps GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY part, iteration)::BIGINT AS total FROM c",
)
def transition_files(spark, sf_dir):
    """Lines of traces, counted by pair; the rest of a trace is other lines."""
    return _transition_rates(spark, sf_dir)[0]


@query(
    "transition_overhead",
    f"""WITH {_PARTS_SQL}, r AS (SELECT part, iteration, count(*) AS total, sum((caller = callee)::INT)::BIGINT AS self FROM steps GROUP BY ALL),
    d AS (SELECT part, iteration, unnest(['total', 'self', 'cross']) AS transition_type, unnest([total, self, total - self]) AS value FROM r) {overhead_sql('d', ['part'], {'part': '0'}, ['transition_type'], 100, 'transition_count')}""",
)
def transition_overhead(spark, sf_dir):
    """All, self and cross transitions of each part of the day against the first."""
    _, rates = _transition_rates(spark, sf_dir)
    return point(pipelines.transition_overhead(stored(rates, "rates"), {"part": 0}, ["part"]), "transition_count")
