"""Comparisons with a baseline."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from runledger.functions.normal import normal_cdf, normal_quantile
from runledger.operators import compare, shape
from runledger.operators.quantiles import quantiles
from runledger.plans.registry import query
from runledger.plans.views import COUNTER_NAMES, COUNTERS_SQL, RUNS_SQL, counters, flag_runs, table
from runledger.session import stored

BASE = {"l_returnflag": "N", "l_linestatus": "F"}
FLAGS = ["l_returnflag", "l_linestatus"]


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), digits) for c in columns})


_MEDIANS = """
    m AS (SELECT r.l_returnflag, r.l_linestatus, median(r.value) AS m, median(b.value) AS b, bool_and(r.l_returnflag = 'N' AND r.l_linestatus = 'F') AS _is_baseline
          FROM runs r JOIN runs b ON b.l_returnflag = 'N' AND b.l_linestatus = 'F' AND b.iteration = r.iteration GROUP BY ALL),
    long AS (SELECT l_returnflag, l_linestatus, t AS _metric_type, _is_baseline,
          CASE t WHEN 'absolute' THEN m WHEN 'delta' THEN m - b ELSE CASE WHEN b <> 0 THEN (m / b - 1) END END AS value
          FROM m CROSS JOIN (VALUES ('absolute'), ('delta'), ('overhead')) v(t))"""


@query("overhead_by_flag", f"WITH {RUNS_SQL}, {_MEDIANS} SELECT l_returnflag, l_linestatus, round(value, 6) AS value, _metric_type, _is_baseline FROM long")
def overhead_by_flag(spark, sf_dir):
    return _rounded(compare.median_overhead(flag_runs(spark, sf_dir), "value", BASE, FLAGS), ["value"])


@query("overhead_relative_only", f"WITH {RUNS_SQL}, {_MEDIANS} SELECT l_returnflag, l_linestatus, round(CASE WHEN _metric_type = 'overhead' THEN value * -100 ELSE value / 1024 END, 6) AS value, _metric_type, _is_baseline FROM long WHERE _metric_type = 'absolute' OR NOT _is_baseline")
def overhead_relative_only(spark, sf_dir):
    """Inverted, in percent, absolute values in another unit, without relative rows of the baseline."""
    rows = compare.median_overhead(flag_runs(spark, sf_dir), "value", BASE, FLAGS, scale=100, inverted=True)
    return _rounded(compare.relative_only(compare.scale_unit(rows, ["value"], 1024)), ["value"])


@query(
    "overhead_by_year",
    """
    WITH runs AS (SELECT l_returnflag, l_linestatus, l_linenumber AS iteration, year(l_shipdate) AS year, median(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
    b AS (SELECT iteration, year, value AS bv FROM runs WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
    m AS (SELECT l_returnflag, l_linestatus, year, median(value) AS m, median(bv) AS b, bool_and(l_returnflag = 'R' AND l_linestatus = 'F') AS _is_baseline
          FROM runs JOIN b USING (iteration, year) GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, year, t AS _metric_type, _is_baseline,
        round(CASE t WHEN 'absolute' THEN m WHEN 'delta' THEN m - b ELSE CASE WHEN b <> 0 THEN m / b - 1 END END, 6) AS value
    FROM m CROSS JOIN (VALUES ('absolute'), ('delta'), ('overhead')) v(t)
    """,
)
def overhead_by_year(spark, sf_dir):
    """An extra group column; rows of years without a baseline are left out."""
    lines = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    runs = stored(quantiles(lines.withColumnRenamed("l_linenumber", "iteration"), [*FLAGS, "iteration", "year"], {"value": ("l_extendedprice", 0.5)}), "runs")
    return _rounded(compare.median_overhead(runs, "value", {"l_returnflag": "R", "l_linestatus": "F"}, FLAGS, extra_groupby=["year"], on_missing="check_off"), ["value"])


@query(
    "mean_overhead_by_flag",
    f"""
    WITH {RUNS_SQL}, s AS (SELECT l_returnflag, l_linestatus, avg(value) AS m, stddev_samp(value) AS s FROM runs GROUP BY ALL),
    j AS (SELECT x.*, b.m AS bm, b.s AS bs, x.l_returnflag = 'N' AND x.l_linestatus = 'F' AS _is_baseline FROM s x, s b WHERE b.l_returnflag = 'N' AND b.l_linestatus = 'F'),
    d AS (SELECT *, m - bm AS dm, sqrt(s * s + bs * bs) AS ds, (m - bm) / nullif(bm, 0) * 100 AS o FROM j)
    SELECT l_returnflag, l_linestatus, _is_baseline, t AS _metric_type,
        round(CASE t WHEN 'value' THEN m WHEN 'value_delta' THEN CASE WHEN NOT _is_baseline THEN dm END ELSE CASE WHEN NOT _is_baseline THEN o END END, 6) AS value,
        round(CASE t WHEN 'value' THEN s WHEN 'value_delta' THEN CASE WHEN NOT _is_baseline THEN ds END
            ELSE CASE WHEN NOT _is_baseline AND dm <> 0 THEN abs(o) * sqrt((ds / dm) ** 2 + (bs / bm) ** 2) END END, 6) AS value_std
    FROM d CROSS JOIN (VALUES ('value'), ('value_delta'), ('value_overhead')) v(t)
    """,
)
def mean_overhead_by_flag(spark, sf_dir):
    return _rounded(compare.mean_overhead(flag_runs(spark, sf_dir), "value", BASE, FLAGS, scale=100), ["value", "value_std"])


def _bootstrap_sql() -> str:
    """The intervals of BASE's comparison by plain sums over all middle values of resamples."""
    keys = "l_returnflag, l_linestatus"
    at_least = "CASE WHEN {x} = 0 THEN 0 WHEN {x} = n THEN 1 ELSE list_sum(list_transform(range((n + 1) // 2, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({x} / n) + (n - j) * ln(1 - {x} / n)))) END"
    halves = lambda a, b: f"CASE WHEN {a} = 0 OR {b} = n THEN 0 ELSE exp(lgamma(n + 1) - 2 * lgamma(n // 2 + 1) + n // 2 * (ln({a} / n) + ln((n - {b}) / n))) END"
    side = lambda c: f"coalesce(sum((n - 1) ** {c} * w * (mean - v) ** {c} / n ** {c}), 0)"
    level = lambda p: normal_cdf(f"(bias + (bias + {p}) / (1 - a * (bias + {p})))")
    low, high = (f"{NormalDist().inv_cdf(p):.17e}" for p in (0.025, 0.975))
    stat = "CASE kind WHEN 'absolute' THEN {x} WHEN 'delta' THEN {x} - {b} ELSE CASE WHEN {b} <> 0 THEN {x} / {b} - 1 END END"
    return f"""
    WITH {RUNS_SQL}, j AS (SELECT r.l_returnflag, r.l_linestatus, r.value AS x, b.value AS b FROM runs r JOIN runs b ON b.l_returnflag = 'N' AND b.l_linestatus = 'F' AND b.iteration = r.iteration),
    s AS (SELECT {keys}, 'x' AS side, x AS v FROM j UNION ALL SELECT {keys}, 'b', b FROM j),
    c AS (SELECT {keys}, side, v, (sum(count(*)) OVER up - count(*))::DOUBLE AS lo, (sum(count(*)) OVER up)::DOUBLE AS hi, (sum(count(*)) OVER whole)::BIGINT AS n FROM s GROUP BY {keys}, side, v
        WINDOW up AS (PARTITION BY {keys}, side ORDER BY v), whole AS (PARTITION BY {keys}, side)),
    law AS (SELECT {keys}, side, m, sum(p) AS p FROM (
        SELECT {keys}, side, v AS m, ({at_least.format(x='hi')}) - ({at_least.format(x='lo')}) - CASE WHEN n % 2 = 1 THEN 0 ELSE ({halves('hi', 'hi')}) - ({halves('lo', 'hi')}) END AS p FROM c
        UNION ALL SELECT {keys}, side, (c.v + u.v) / 2, ({halves('c.hi', 'u.lo')}) - ({halves('c.lo', 'u.lo')}) - ({halves('c.hi', 'u.hi')}) + ({halves('c.lo', 'u.hi')}) FROM c JOIN (SELECT * RENAME (n AS un) FROM c) u USING ({keys}, side) WHERE n % 2 = 0 AND u.lo >= c.hi) GROUP BY ALL),
    k AS (SELECT unnest(['absolute', 'delta', 'overhead']) AS kind),
    laws AS (SELECT x.l_returnflag, x.l_linestatus, kind, {stat.format(x='x.m', b='b.m')} AS pos, sum(x.p * b.p) AS p FROM law x JOIN law b USING ({keys}) CROSS JOIN k WHERE x.side = 'x' AND b.side = 'b' GROUP BY ALL),
    o AS (SELECT {keys}, side, n, max(v) FILTER (lo < n // 2 AND hi >= n // 2) AS h, max(v) FILTER (lo < n // 2 + 1 AND hi >= n // 2 + 1) AS i, max(v) FILTER (lo < n // 2 + 2 AND hi >= n // 2 + 2) AS k, count(*) = 1 AS flat FROM c GROUP BY ALL),
    m AS (SELECT *, CASE WHEN n % 2 = 1 THEN i ELSE (h + i) / 2 END AS median FROM o),
    z AS (SELECT {keys}, side, n, flat, median, unnest(CASE WHEN n % 2 = 1 THEN [{{'v': (i + k) / 2, 'w': n // 2}}, {{'v': (h + k) / 2, 'w': 1}}, {{'v': (h + i) / 2, 'w': n // 2}}] ELSE [{{'v': i, 'w': n // 2}}, {{'v': h, 'w': n // 2}}] END, recursive := true) FROM m),
    ja AS (SELECT q.l_returnflag, q.l_linestatus, q.side, kind, q.n, q.w, CASE q.side WHEN 'x' THEN {stat.format(x='q.v', b='other.median')} ELSE {stat.format(x='other.median', b='q.v')} END AS v
        FROM z q JOIN m other ON other.l_returnflag = q.l_returnflag AND other.l_linestatus = q.l_linestatus AND other.side <> q.side CROSS JOIN k WHERE q.side = 'x' OR kind <> 'absolute'),
    jm AS (SELECT *, sum(w * v) OVER g / sum(w) OVER g AS mean FROM ja WHERE v IS NOT NULL WINDOW g AS (PARTITION BY {keys}, side, kind)),
    acc AS (SELECT {keys}, kind, CASE WHEN {side(2)} > 0 THEN {side(3)} / (6 * {side(2)} ** 1.5) ELSE 0 END AS a FROM jm GROUP BY ALL),
    st AS (SELECT x.l_returnflag, x.l_linestatus, kind, {stat.format(x='x.median', b='b.median')} AS stat, x.n > 1 AND NOT (x.flat AND (kind = 'absolute' OR b.flat)) AS has_interval FROM m x JOIN m b USING ({keys}) CROSS JOIN k WHERE x.side = 'x' AND b.side = 'b'),
    bi AS (SELECT {keys}, kind, any_value(stat) AS stat, any_value(has_interval) AS has_interval, sum(CASE WHEN pos < stat THEN p WHEN pos = stat THEN p / 2 ELSE 0 END) / sum(p) AS below FROM laws JOIN st USING ({keys}, kind) WHERE pos IS NOT NULL GROUP BY ALL),
    ba AS (SELECT *, {normal_quantile('below')} AS bias FROM bi JOIN acc USING ({keys}, kind)),
    lv AS (SELECT *, {level(low)} AS low, {level(high)} AS high FROM ba),
    cu AS (SELECT *, sum(p) OVER (PARTITION BY {keys}, kind ORDER BY pos) AS upto, sum(p) OVER (PARTITION BY {keys}, kind) AS mass FROM laws WHERE pos IS NOT NULL),
    f AS (SELECT {keys}, kind, any_value(stat) AS stat, min(pos) FILTER (has_interval AND upto >= low * mass - 1e-12) AS low, min(pos) FILTER (has_interval AND upto >= high * mass - 1e-12) AS high FROM cu JOIN lv USING ({keys}, kind) GROUP BY ALL)
    SELECT {keys}, l_returnflag = 'N' AND l_linestatus = 'F' AS _is_baseline, kind AS _metric_type, round(st.stat, 6) AS value, round(f.low, 6) AS value_low, round(f.high, 6) AS value_high FROM st LEFT JOIN f USING ({keys}, kind)
    """


@query("bootstrap_overhead", _bootstrap_sql())
def bootstrap_overhead(spark, sf_dir):
    """With bias-corrected and accelerated intervals of the exact law of resampled medians."""
    return _rounded(compare.overhead(flag_runs(spark, sf_dir), "value", BASE, FLAGS), ["value", "value_low", "value_high"])


@query(
    "quartile_deltas_by_status",
    """
    WITH s AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, quantile_cont(o_totalprice, 0.25) AS q25, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY ALL),
    j AS (SELECT s.*, b.mean AS bmean, b.median AS bmedian, b.q75 AS bq75 FROM s LEFT JOIN s b ON b.o_orderstatus = 'F' AND b.o_orderpriority = s.o_orderpriority)
    SELECT o_orderpriority, o_orderstatus, round(mean, 4) AS mean, round(std, 4) AS std, round(q25, 4) AS q25, round(q75, 4) AS q75,
        round(median - bmedian, 4) AS median_delta, round((mean - bmean) / nullif(bmean, 0), 6) AS mean_norm, round((q75 - bq75) / nullif(bq75, 0), 6) AS q75_norm FROM j
    """,
)
def quartile_deltas_by_status(spark, sf_dir):
    out = compare.quartile_deltas(table(spark, sf_dir, "orders"), "o_totalprice", {"o_orderstatus": "F"}, ["o_orderpriority"], ["o_orderstatus"])
    return out.select("o_orderpriority", "o_orderstatus", *[F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q75", "median_delta")], *[F.round(c, 6).alias(c) for c in ("mean_norm", "q75_norm")])


_RATIOS = {
    "cycles_per_insn": "cpu_cycles / inst_retired",
    "ipc": "inst_retired / cpu_cycles",
    "br_pred_miss_rate": "br_mis_pred / br_pred",
    "insn_spec_rate": "inst_retired / inst_spec",
    "eff_backend_ipc": "inst_retired / (cpu_cycles - stall_backend)",
    "l1i_hit_rate": "(l1i_cache - l1i_cache_refill) / l1i_cache",
    "l1d_hit_rate": "(l1d_cache - l1d_cache_refill) / l1d_cache",
}


@query(
    "derived_counter_metrics",
    f"""
    WITH {COUNTERS_SQL}, w AS (SELECT l_returnflag, iteration, {", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in COUNTER_NAMES)} FROM counters GROUP BY ALL),
    d AS (SELECT l_returnflag, iteration, unnest([{", ".join(f"'{n}'" for n in _RATIOS)}]) AS name, unnest([{", ".join(_RATIOS.values())}]) AS value FROM w)
    SELECT l_returnflag, iteration, name, round(value, 5) AS value FROM counters UNION ALL SELECT l_returnflag, iteration, name, round(value, 5) FROM d
    """,
)
def derived_counter_metrics(spark, sf_dir):
    out = shape.with_derived_metrics(counters(spark, sf_dir), ["l_returnflag", "iteration"], "name", "value")
    return out.withColumn("value", F.round("value", 5))


@query(
    "counter_summary_pivot",
    f"""
    WITH {COUNTERS_SQL}, m AS (SELECT r.l_returnflag, r.name, median(r.value) AS m, median(b.value) AS b FROM counters r JOIN counters b ON b.l_returnflag = 'N' AND b.iteration = r.iteration AND b.name = r.name GROUP BY ALL)
    SELECT l_returnflag, round(max(CASE name WHEN 'cpu_cycles' THEN m - b END), 4) AS cpu_cycles, round(max(CASE name WHEN 'inst_retired' THEN m - b END), 4) AS inst_retired,
        round(max(CASE name WHEN 'br_pred' THEN m - b END), 4) AS br_pred FROM m GROUP BY l_returnflag
    """,
)
def counter_summary_pivot(spark, sf_dir):
    """Counter deltas from the baseline's medians as a table, one column for each counter."""
    rows = compare.median_overhead(counters(spark, sf_dir), "value", {"l_returnflag": "N"}, ["l_returnflag"], extra_groupby=["name"])
    wanted = ["cpu_cycles", "inst_retired", "br_pred"]
    return _rounded(shape.pivoted(rows.where("_metric_type = 'delta'"), ["l_returnflag"], "name", wanted, "value"), wanted, 4)


@query(
    "percent_below_baseline",
    """
    WITH s AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT s.o_orderpriority, s.o_orderstatus, round(s.v, 4) AS v, round((b.v - s.v) * 100 / b.v, 6) AS overhead
    FROM s JOIN s b ON b.o_orderstatus = 'O' AND b.o_orderpriority = s.o_orderpriority WHERE s.o_orderstatus <> 'O'
    """,
)
def percent_below_baseline(spark, sf_dir):
    stats = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    out = compare.percent_below(stats, "v", {"o_orderstatus": "O"}, ["o_orderpriority"])
    return out.select("o_orderpriority", "o_orderstatus", F.round("v", 4).alias("v"), F.round("overhead", 6).alias("overhead"))
