"""Exact bootstrap of medians: the law of a resample's median instead of resamples.

A resample draws n values from the n of a sample, each with equal chance. Its lower middle value is at most v if at
least half of the draws fall on values up to v, which has a binomial chance; with an even n the two middle values have a
joint law in closed form. So the distinct values of a sample, with the share of rows below each, give the law of the median. The
law of a comparison of two independent medians is that of all pairs of their values. Bias-corrected and accelerated bounds
are quantiles of the law: they depend on no seed, and no task holds a sample.

Chances below 1e-18 are left out. Values that no resample's median can reach, beyond some 12 deviations of the rank, have none, so the
values in play grow with the square root of a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.normal import log_factorial, normal_cdf, normal_quantile
from runledger.operators.ordered import running
from runledger.session import stored

NAN = float("nan")
LEVEL = 0.95
#: Chances that count, and rows between two middle values of a resample that do (their chance falls by e with each).
LEAST, APART = 1e-18, 50
#: Parts that the values of one median are dealt into when they meet those of another.
SALTS = 16
#: Rows of a sample up to which one task may rank its values and those of its comparisons: some 2,000 medians, and their pairs.
SMALL_SAMPLE = 64


def _at_least(below: str) -> str:
    """P(at least _k of _n draws fall on `below` of _n rows), summed from _k away from the mean; _choose is the logarithm of _n over _k,
    _choose_less of _n over _k - 1."""
    p = f"({below} / _n)"
    reach = f"(cast(ceil(12e0 * sqrt(_n * {p} * (1e0 - {p}))) as bigint) + 30)"
    start = lambda j, choose: f"named_struct('term', exp({choose} + ({j}) * ln({p}) + (_n - ({j})) * ln(1e0 - {p})), 'sum', 0e0, 'odds', {p} / (1e0 - {p}))"
    step = lambda ratio: f"(s, j) -> named_struct('term', s.term * ({ratio}), 'sum', s.sum + s.term, 'odds', s.odds)"
    up = f"aggregate(sequence(_k, least(_n, _k + {reach})), {start('_k', '_choose')}, {step('(_n - j) / (j + 1e0) * s.odds')}).sum"
    down = f"aggregate(sequence(_k - 1, greatest(0L, _k - 1 - {reach}), -1L), {start('_k - 1', '_choose_less')}, {step('j / (_n - j + 1e0) / s.odds')}).sum"
    return f"CASE WHEN {below} <= 0 THEN 0e0 WHEN {below} >= _n THEN 1e0 WHEN _k > _n * {p} THEN {up} ELSE 1e0 - {down} END"


def _halves(a: str, b: str) -> str:
    """Chance that half of the draws fall on `a` rows and the others on those from `b` on."""
    return f"coalesce(exp(_choose + floor(_n / 2) * (CASE WHEN {a} > 0 THEN ln({a} / _n) END + CASE WHEN {b} < _n THEN ln((_n - {b}) / _n) END)), 0e0)"


def _log_choose(k: str) -> str:
    return f"{log_factorial('_n')} - {log_factorial(k)} - {log_factorial(f'(_n - {k})')}"


def _ranked(df: DataFrame, keys: Sequence[str], order: str, of: str, name: str, total: str, small: bool) -> DataFrame:
    """Adds the sum of a column over the rows before and over all rows of the keys; over range partitions unless all groups are small."""
    if not small:
        return running(df, list(keys), [order], {name: of}, totals={total: name})
    every = Window.partitionBy(*keys)
    before = every.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: F.coalesce(F.sum(of).over(before), F.lit(0)), total: F.sum(of).over(every)})


def _cells(samples: DataFrame, keys: Sequence[str], value: str, small: bool = False) -> DataFrame:
    """The distinct values of each sample with _lo and _hi, the rows below and up to each, and _n, the rows of the sample."""
    counts = samples.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = _ranked(counts, keys, "_v", "_c", "_lo", "_n", small)
    return stored(ranked.select(*keys, "_v", "_lo", F.expr("_lo + _c").alias("_hi"), "_n"), "values")


def median_law(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _m, _p: the values that the median of a resample takes, with their chances; of the samples that _cells() ranks."""
    # Ranks in reach of a middle value.
    near = cells.withColumn("_k", F.expr("floor((_n + 1) / 2)")).where("_hi >= _k - 6 * sqrt(_n) - 30 AND _lo <= _k + 6 * sqrt(_n) + 30")
    chosen = near.selectExpr("*", f"{_log_choose('_k')} AS _choose", f"{_log_choose('(_k - 1)')} AS _choose_less")
    at = chosen.selectExpr("*", f"({_at_least('_hi')}) - ({_at_least('_lo')}) AS _own")
    # Of an even number half of the draws fall up to a value and the other half from another on, or both middle ones on one.
    alone = at.selectExpr(*[f"`{k}`" for k in keys], "_v AS _m", f"CASE WHEN _n % 2 = 1 THEN _own ELSE _own - {_halves('_hi', '_hi')} + {_halves('_lo', '_hi')} END AS _p")
    even = chosen.where("_n % 2 = 0")
    # The upper value is among the next rows: they share a bucket of ranks, or the next one.
    upper = even.selectExpr(*[f"`{k}` AS `_u_{k}`" for k in keys], "_v AS _uv", "_lo AS _ulo", "_hi AS _uhi", f"floor(_lo / {APART}) AS _at")
    lower = even.selectExpr("*", f"explode(array(floor(_hi / {APART}), floor(_hi / {APART}) + 1)) AS _bucket")
    pairs = lower.join(upper, F.expr(" AND ".join([*[f"`{k}` <=> `_u_{k}`" for k in keys], "_bucket = _at", "_ulo >= _hi"])))
    two = pairs.selectExpr(*[f"`{k}`" for k in keys], "(_v + _uv) / 2 AS _m", f"{_halves('_hi', '_ulo')} - {_halves('_lo', '_ulo')} - {_halves('_hi', '_uhi')} + {_halves('_lo', '_uhi')} AS _p")
    return alone.unionByName(two).groupBy(*keys, "_m").agg(F.sum("_p").alias("_p")).where(F.col("_p") > LEAST)


def _middles(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _n, _median and the medians without one row: _jl (without one below), _jc (without the middle one), _jr."""
    ranked = lambda k: f"max(CASE WHEN _lo < floor(_n / 2) + {k} AND _hi >= floor(_n / 2) + {k} THEN _v END)"
    got = cells.groupBy(*keys).agg(*[F.expr(e) for e in ("first(_n) AS _n", f"{ranked(0)} AS _a", f"{ranked(1)} AS _b", f"{ranked(2)} AS _c", "max(_v) = min(_v) AS _flat", "bool_or(isnan(_v)) AS _odd")])
    odd = lambda x, y: f"CASE WHEN _n % 2 = 1 THEN {x} ELSE {y} END"
    return got.selectExpr(*[f"`{k}`" for k in keys], "_n", "_flat", "_odd", f"{odd('_b', '(_a + _b) / 2')} AS _median", f"{odd('(_b + _c) / 2', '_b')} AS _jl", f"{odd('(_a + _c) / 2', 'NULL')} AS _jc", f"{odd('(_a + _b) / 2', '_a')} AS _jr")


def _statistic(kind: str, x: Column, b: Column, scale: float) -> Column:
    if kind == "absolute":
        return x
    return x - b if kind == "delta" else F.when(b != 0, (F.try_divide(x, b) - 1) * scale).otherwise(F.lit(NAN))


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _accelerations(both: DataFrame, keys: Sequence[str], kinds: Sequence[str], scale: float) -> DataFrame:
    """keys, kind, a: from the deviations of the statistic without one row each; it takes three values at most for each sample."""
    ways = []
    for side in "xb":
        n = F.col(f"{side}_n")
        half = F.floor(n / 2)
        for c, rows in (("_jl", half), ("_jc", n - 2 * half), ("_jr", half)):
            x, b = (F.col(f"{side}{c}"), F.col("b_median")) if side == "x" else (F.col("x_median"), F.col(f"{side}{c}"))
            ways.append(F.struct(F.lit(side).alias("side"), n.alias("n"), rows.alias("w"), x.alias("x"), b.alias("b")))
    each = both.select(*keys, F.explode(F.array(*ways)).alias("_t")).select(*keys, "_t.*").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    value = F.lit(NAN)
    for k in kinds:
        value = F.when(F.col("kind") == k, _statistic(k, F.col("x"), F.col("b"), scale)).otherwise(value)
    each = each.where("side = 'x' OR kind <> 'absolute'").withColumn("v", value).where((F.col("w") > 0) & _known(F.col("v")))
    # Six rows of a group and kind.
    own = Window.partitionBy(*keys, "kind", "side")
    u = (F.col("n") - 1) * (F.sum(F.col("w") * F.col("v")).over(own) / F.sum("w").over(own) - F.col("v"))
    sums = [F.sum(F.col("w") * F.pow(F.col("u"), F.lit(k)) / F.pow(F.col("n"), F.lit(k))) for k in (3.0, 2.0)]
    summed = each.withColumn("u", u).groupBy(*keys, "kind").agg(sums[0].alias("up"), sums[1].alias("down"))
    return summed.select(*keys, "kind", F.when(F.col("down") > 0, F.col("up") / (6 * F.pow("down", F.lit(1.5)))).otherwise(0.0).alias("a"))


def intervals(rows: DataFrame, keys: Sequence[str], value: str, base: str, kinds: Sequence[str], scale: float = 1.0, level: float = LEVEL) -> DataFrame:
    """keys, _metric_type, _stat, _low, _high for each kind: absolute (the median of value), delta and overhead (against base).

    Bounds are the least values whose chance reaches the level. They are NaN where there is nothing to resample: one row,
    constant samples, NaN or null among the values, a statistic that is NaN.
    """
    keys = list(keys)
    nan = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(NAN))
    sides = F.explode(F.array(F.struct(F.lit("x").alias("s"), nan(value).alias("v")), F.struct(F.lit("b").alias("s"), nan(base).alias("v"))))
    samples = rows.select(*keys, sides.alias("_e")).select(*keys, F.col("_e.s").alias("_side"), F.col("_e.v").alias("_sample"))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    small = most <= SMALL_SAMPLE
    cells = _cells(samples, [*keys, "_side"], "_sample", small)
    middles = _middles(cells, [*keys, "_side"])
    by_side = {s: middles.where(F.col("_side") == s).select(*[F.col(k).alias(k if s == "x" else f"_b_{k}") for k in keys], *[F.col(c).alias(f"{s}{c}") for c in middles.columns if c not in keys and c != "_side"]) for s in "xb"}
    both = by_side["x"].join(by_side["b"], [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])


    # One row for each group and kind: the statistic and whether it has an interval.
    told = []
    for kind in kinds:
        stat = _statistic(kind, F.col("x_median"), F.col("b_median"), scale)
        some, flat = _known(stat), F.lit(True)
        for s in "x" if kind == "absolute" else "xb":
            some = some & (F.col(f"{s}_n") > 1) & ~F.col(f"{s}_odd")
            flat = flat & F.col(f"{s}_flat")
        told.append(F.struct(F.lit(kind).alias("kind"), stat.alias("stat"), (some & ~flat).alias("some")))
    stats = both.select(*keys, F.explode(F.array(*told)).alias("_t")).select(*keys, "_t.*")
    turned = _accelerations(both, keys, kinds, scale)

    law = stored(median_law(cells.where(~F.isnan("_v")), [*keys, "_side"]), "medians")
    x = law.where("_side = 'x'").select(*keys, F.col("_m").alias("_x"), F.col("_p").alias("_px"), F.pmod(F.xxhash64("_m"), F.lit(SALTS)).alias("_salt"))
    b = law.where("_side = 'b'").select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_m").alias("_bm"), F.col("_p").alias("_pb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_b_salt"))
    laws = x.select(*keys, F.lit("absolute").alias("kind"), F.col("_x").alias("at"), F.col("_px").alias("p")) if "absolute" in kinds else None
    pairs = [k for k in kinds if k != "absolute"]
    if pairs:
        met = x.join(b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys] + [F.col("_salt") == F.col("_b_salt")])
        each = F.array(*[F.struct(F.lit(k).alias("kind"), _statistic(k, F.col("_x"), F.col("_bm"), scale).alias("at"), (F.col("_px") * F.col("_pb")).alias("p")) for k in pairs])
        compared = met.select(*keys, F.explode(each).alias("_t")).select(*keys, "_t.*").where(_known(F.col("at")) & (F.col("p") > LEAST))
        laws = compared if laws is None else laws.unionByName(compared)
    summed = laws.groupBy(*keys, "kind", "at").agg(F.sum("p").alias("p"))
    ranked = _ranked(summed, [*keys, "kind"], "at", "p", "before", "mass", small)

    same = lambda df, c: [F.col(k).eqNullSafe(F.col(f"{c}{k}")) for k in [*keys, "kind"]]
    named = lambda df, c: df.withColumnsRenamed({k: f"{c}{k}" for k in [*keys, "kind"]})
    joined = named(ranked, "_l_").join(stats, same(stats, "_l_"))
    weigh = F.first("mass").alias("mass"), F.sum(F.when(F.col("at") < F.col("stat"), F.col("p")).when(F.col("at") == F.col("stat"), F.col("p") / 2).otherwise(0.0)).alias("below")
    levels = joined.groupBy(*keys, "kind").agg(*weigh).withColumn("below", F.col("below") / F.col("mass"))
    levels = levels.join(named(turned, "_a_"), same(levels, "_a_")).select(*keys, "kind", "mass", "below", "a")
    levels = levels.withColumn("bias", F.expr(normal_quantile("below")))
    for name, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2)):
        z = F.col("bias") + F.expr(normal_quantile(f"{p:.17e}"))
        levels = levels.withColumn("_z", F.col("bias") + z / (1 - F.col("a") * z)).withColumn(f"{name}_level", F.expr(normal_cdf("_z")))
    found = named(ranked, "_l_").join(levels.select(*keys, "kind", "low_level", "high_level"), same(levels, "_l_"))
    # A level that a sum of chances meets but for rounding is met.
    reached = lambda c: F.min(F.when(F.col("before") + F.col("p") >= F.col(c) * F.col("mass") - 1e-12, F.col("at")))
    bounds = found.groupBy(*keys, "kind").agg(reached("low_level").alias("_low"), reached("high_level").alias("_high"))
    out = stats.join(named(bounds, "_o_"), same(stats, "_o_"), "left")
    given = lambda c: F.coalesce(F.when(F.col("some"), F.col(c)), F.lit(NAN))
    return out.select(*keys, F.col("kind").alias("_metric_type"), F.coalesce("stat", F.lit(NAN)).alias("_stat"), given("_low").alias("_low"), given("_high").alias("_high"))
