"""What a user calls: files of many runs in, result tables out. Compositions of readers and operators.

`runs` has dataset_id and the axes; readers' files are matched to runs by the dataset id in their path, iterations too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.scalars import HALF, basename, decimal_to_hex, ordered_decimal, ordered_to_hex
from runledger.keys import keep_drop
from runledger.operators import align, compare, coords, histogram, intervals, layouts, shape, trace
from runledger.operators.quantiles import quantiles
from runledger.sources import readers

#: Folders of an iteration and of a run, as sessions or partitioned writers name them.
ITERATION = r"/iteration[-_=]?([0-9]+)"
DATASET = r"/(?:dataset=)?([0-9a-f]{8}-[0-9a-f-]{27})/"


def with_runs(data: DataFrame, runs: DataFrame, iteration: str = ITERATION, dataset: str = DATASET) -> DataFrame:
    """Axes and iteration of each row, from the path of its file; rows of unknown runs are left out."""
    found = F.regexp_extract("file", iteration, 1)
    keyed = data.withColumns({"dataset_id": F.regexp_extract("file", dataset, 1), "iteration": F.when(found == "", -1).otherwise(found.try_cast("int"))})
    return keyed.join(runs, "dataset_id").drop("file")


def sliced(df: DataFrame, fixed: Sequence[str], analysis: Callable[..., DataFrame], params: Sequence[str], keep: Sequence[Mapping] = (), drop: Sequence[Mapping] = (), **options) -> DataFrame:
    """One job for all slices: fixed axes become group keys of the analysis."""
    return analysis(keep_drop(df, keep, drop), params=[*params], extra_groupby=list(fixed), **options)


def timing_comparison(spark: SparkSession, path: str, runs: DataFrame, baseline: Mapping, params: Sequence[str], tool: str = "time", metric: str = "times", **options) -> DataFrame:
    data = {"time": readers.read_posix_time, "hyperfine": readers.read_hyperfine}[tool](spark, path)
    return compare.relative_only(compare.overhead(with_runs(data, runs), metric, baseline, params, **options))


def throughput_summary(spark: SparkSession, path: str, runs: DataFrame, baseline: Mapping, params: Sequence[str], unit: str = "Mbps", **options) -> DataFrame:
    """Receiver side, in the unit; overheads stay ratios."""
    data = with_runs(readers.read_iperf(spark, path).where("side = 'receiver'"), runs)
    metric = "bits_per_second"
    rows = compare.overhead(data, metric, baseline, params, **options)
    return compare.relative_only(compare.scale_unit(rows, [metric, f"{metric}_low", f"{metric}_high"], compare.RATES[unit]))


def rpc_summary(spark: SparkSession, path: str, runs: DataFrame, baseline: Mapping, params: Sequence[str], metric: str = "qps", **options) -> DataFrame:
    """Requests per second, or a latency in milliseconds."""
    data = with_runs(readers.read_qps(spark, path), runs)
    if metric.startswith("latency"):
        data = data.withColumn(metric, F.col(metric) / 1000)
    return compare.overhead(data, metric, baseline, params, extra_groupby=["req_size", "resp_size"], **options)


def store_summary(spark: SparkSession, path: str, runs: DataFrame, baseline: Mapping, params: Sequence[str], **options) -> DataFrame:
    data = with_runs(readers.read_redis(spark, path), runs)
    return compare.relative_only(compare.overhead(data, "requests_per_second", baseline, params, **options))


def counter_summary(spark: SparkSession, path: str, runs: DataFrame, baseline: Mapping, params: Sequence[str], kind: str = "absolute", names: Sequence[str] = (), cpus: Sequence[int] = (), group: str | None = None, **options) -> DataFrame:
    """Counters of chosen CPUs added up, ratios derived, compared; kind is a metric type.

    group: the axis of counter groups, which are taken in executions of their own, so no ratio mixes them.
    """
    data = with_runs(readers.read_counters(spark, path), runs)
    if names:
        data = data.where(F.col("name").isin(list(names)))
    if cpus:
        data = data.where(F.col("cpu").isNull() | F.col("cpu").isin(list(cpus)))
    keys = ["dataset_id", *dict.fromkeys([*params, *([group] if group else [])]), "iteration"]
    long = shape.with_derived_metrics(shape.sum_over_cpus(data, keys, "name", "value"), keys, "name", "value")
    return compare.overhead(long, "value", baseline, params, extra_groupby=["name"], **options).where(F.col("_metric_type") == kind)


def folded_stacks(spark: SparkSession, path: str) -> DataFrame:
    return trace.folded(readers.read_callgraph(spark, path))


def before_after_samples(spark: SparkSession, before: str, after: str, runs: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Changes of numeric name=value samples, every run with every name."""
    sides = []
    for path in (before, after):
        data = with_runs(readers.read_sysctl(spark, path), runs).withColumn("value", F.col("sysctl_value").try_cast("double")).where("value is not null")
        sides.append(data.where(F.col("sysctl_name").isin(list(names))) if names else data)
    delta = align.before_after(sides[0], sides[1], ["dataset_id", "iteration", "sysctl_name"], ["value"])
    return align.completed(delta, ["dataset_id", "iteration"], ["sysctl_name"], ["value"])


def transition_frequency(spark: SparkSession, path: str, runs: DataFrame, params: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs with the run's total, self transitions) per run and iteration."""
    data = with_runs(readers.read_transitions(spark, path), runs)
    run = [*params, "iteration"]
    counts = trace.transition_counts(data, run)
    return counts, trace.self_transitions(counts, run)


def transition_overhead(rates: DataFrame, baseline: Mapping, params: Sequence[str], **options) -> DataFrame:
    """All, self and cross transitions of each run against the baseline's, overheads in percent."""
    long = shape.unpivoted(rates, [*params, "iteration"], ["total", "self", "cross"], "transition_type", "transition_count")
    return compare.overhead(long, "transition_count", baseline, params, extra_groupby=["transition_type"], scale=100, **options)


def code_churn(lines: DataFrame, components: Sequence[shape.Component], baseline: Mapping, run: Sequence[str], known: DataFrame | None = None, accept: Sequence[str] = (), reject: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(changed lines by component in percent of the baseline's, files of the build that were not counted)."""
    kept = shape.accept_reject(lines, "name", accept, reject)
    missing = None
    if known is not None:
        missing = known.join(kept.select("name").distinct(), "name", "left_anti")
        kept = kept.join(known.select("name").distinct(), "name", "left_semi")
    named = shape.with_component(kept, "name", components)
    return shape.component_rollup(named, "component", "name", ["code"], baseline, run), missing


def imprecise_report(members: DataFrame, key: Sequence[str], category: str) -> tuple[DataFrame, DataFrame]:
    """(annotated members of structures with an imprecise member, summary by category)."""
    flagged = layouts.group_flags(members, key, ["is_imprecise"]).where("any_is_imprecise")
    annotated = layouts.annotated_members(flagged, key)
    return annotated, layouts.layout_summary(flagged.where("is_imprecise"), category, key[0], "array_items", "is_pointer")


VLA_FIELDS = ("member_name", "file", "line", "byte_offset", "max_vla_size")


def vla_report(layout: DataFrame, groups: Sequence[str], ignore: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(arrays of variable length with the largest size that can be represented, how many by group).

    layout: members of structures, their arrays with max_vla_size. Files that match a pattern to ignore are left out.
    """
    kept = shape.drop_matching(layout.where("has_vla and max_vla_size is not null"), "file", ignore)
    return kept.select(*groups, *VLA_FIELDS), kept.groupBy(*groups).agg(F.count("member_name").alias("member_name"))


def size_distribution(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    low, high = histogram.data_range(df, column)
    return histogram.histogram(df, groups, column, histogram.power_of_two_edges(low, high))


def bar_table(df: DataFrame, x: str, value: str, order: str, shift_by: str | None = None, stack_by: str | None = None, high: str | None = None) -> DataFrame:
    return coords.bar_labels(coords.layout_bars(df, x, order, shift_by, stack_by, value), value, high)


def network_metrics(spark: SparkSession, path: str, runs: DataFrame, fields: Sequence[str], baseline: Mapping, params: Sequence[str], **options) -> DataFrame:
    data = shape.lower_columns(with_runs(readers.read_netperf(spark, path, fields), runs))
    long = shape.unpivoted(data, [*params, "iteration"], [f.lower() for f in fields], "metric")
    return compare.overhead(long, "value", baseline, params, extra_groupby=["metric"], **options)


def http_load(spark: SparkSession, path: str, runs: DataFrame, baseline: Mapping, params: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(means of other runs in percent below the baseline, bands of requests per second)."""
    data = with_runs(readers.read_wrk(spark, path), runs)
    groups = [*params, "request_size"]
    means = data.groupBy(*groups).agg(F.avg("requests_per_second").alias("requests_per_second"))
    free = [g for g in groups if g not in baseline]
    return compare.percent_below(means, "requests_per_second", baseline, free), histogram.bands(data, groups, "requests_per_second")


def allocator_table(before: DataFrame, after: DataFrame, baseline: Mapping, run: Sequence[str], q: float = 0.9, cap: int = 30) -> DataFrame:
    """Zones whose change over the baseline run is in the upper quantile (a top-k report)."""
    delta = align.before_after(before, after, [*run, "name"], list(readers.ZONE_FIELDS), keep=["size"])
    moved = align.varying_keys(align.nonzero_keys(delta, ["name"], "used"), ["name"], "used")
    stats = compare.quartile_deltas(moved, "used", baseline, ["name"], run)
    return align.top_quantile(stats.withColumn("size_of_change", F.abs("median_delta")), list(run), "size_of_change", q, cap, ["name"])


def struct_statistics(members: DataFrame, key: Sequence[str], target: str, baseline: str, **columns: str) -> DataFrame:
    totals = layouts.struct_totals(members, [*key, target], **columns)
    return layouts.cache_line_growth(totals, key, target, baseline)


def bounds_distribution(spark: SparkSession, path: str, large: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(distribution of sizes by kind, bounds over a size, largest first)."""
    data = readers.read_bounds(spark, path).dropDuplicates(["alignment_bits", "size", "kind", "source_loc", "details"])
    return size_distribution(data.where("size is not null"), ["kind"], "size"), data.where(F.col("size") > large).orderBy(F.desc("size"), "source_loc")


def executed(data: DataFrame, by: Sequence[Column | str], kernel: bool | None = None) -> DataFrame:
    """Executions by address and more, of all addresses, of the kernel's or of others."""
    if kernel is not None:
        data = data.where((F.col("address") > trace.KERNEL_BASE - HALF) == F.lit(kernel))
    return data.groupBy("address", *by).agg(F.count("*").alias("n"))


def with_symbol(counts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Counts by address with the symbol around it; an address outside all symbols stands for itself."""
    ranges = symbols.select("name", ordered_decimal(F.col("addr")).alias("low"), ordered_decimal(F.col("addr") + F.col("size")).alias("high"))
    named = intervals.range_join(counts, ranges, "address", "low", "high", how="left")
    return named.withColumn("symbol", F.coalesce("name", F.concat(F.lit("0x"), ordered_to_hex(F.col("address")))))


def executed_calls(counts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by symbol, from executions by address."""
    starts = symbols.select("name", ordered_decimal(F.col("addr")).alias("addr"))
    return trace.call_sites(counts, starts, "address")


def instruction_histogram(spark: SparkSession, path: str, symbols: DataFrame, kernel: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(instructions by symbol and class, calls by symbol). Executions are counted by address before names are joined."""
    data = readers.read_instructions(spark, path)
    counts = executed(data, [trace.instruction_class(F.col("mnemonic"), F.col("operands")).alias("class")], kernel)
    return trace.per_symbol(with_symbol(counts, symbols), "symbol", "class", "n"), executed_calls(executed(data, [], kernel), symbols)


def instructions_per_call(icounts: DataFrame, calls: DataFrame, baseline: str, run: str = "dataset_gid") -> DataFrame:
    """Median instructions and calls of each function over a run's iterations, their ratio, and its change from the baseline run's."""
    n, c = {"n": ("instr_count", 0.5)}, {"calls": ("call_count", 0.5)}
    if calls is icounts:
        # One table has both, so one pass finds both.
        return trace.per_call(quantiles(icounts, ["symbol", run], n | c), None, ["symbol"], [run], baseline)
    return trace.per_call(quantiles(icounts, ["symbol", run], n), quantiles(calls, ["symbol", run], c), ["symbol"], [run], baseline)


def counter_tracks(values: DataFrame, zones: DataFrame, labels: Mapping[int, str], monotonic: Sequence[int] = (), run: Sequence[str] = ("iteration",), per_cpu: Mapping[int, int] | None = None) -> DataFrame:
    """Counters of known zones by their display name; those that only rise begin at 1 in each iteration."""
    kept = align.members_of(values, "name", zones, "name")
    group = [*run, "name", "slot"]
    rises = F.col("slot").isin(list(monotonic)) if monotonic else F.lit(False)
    first = trace.rebased(kept.where(rises), group, "ts", "value").drop("rel_ts")
    both = first.unionByName(kept.where(~F.coalesce(rises, F.lit(False))))
    return both.withColumn("counter_name", trace.counter_name(F.col("name"), F.col("slot"), labels, per_cpu))


def struct_report(members: DataFrame, key: Sequence[str], target: str, baseline: str, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distribution of padding by target, statistics of sizes against the baseline's, structures that take more cache lines)."""
    totals = layouts.struct_totals(members, [*key, target], **columns)
    padded = totals.where("padding > 0")
    spread = histogram.histogram(padded, [target], "padding", histogram.power_of_two_edges(*histogram.data_range(padded, "padding")))
    sizes = compare.quartile_deltas(totals.withColumn("_all", F.lit(0)), "size", {target: baseline}, ["_all"], [target]).drop("_all")
    return spread, sizes, layouts.cache_line_growth(totals, key, target, baseline)


def advisory_history(advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advisories of each year, those of memory safety and of spatial memory safety; the running share of those mitigated by
    pointer bounds alone, sub-object bounds and nothing)."""
    kinds = {"memory_safety": F.col("kind_memory_safety"), "spatial_safety": F.col("kind_memory_safety") & ~F.col("kind_uaf") & ~F.col("kind_race")}
    bounds = F.col("mitigation_ptr_bounds") & ~F.col("mitigation_subobject")
    how = F.when(F.col("mitigation_subobject"), "subobject").when(bounds, "ptr_bounds").when(F.col("mitigation_unmitigated"), "unmitigated").otherwise("other")
    by = advisories.where("kind_memory_safety").select(how.alias("mitigation"), F.lit(1).alias("n"))
    return histogram.conditional_shares(advisories, ["year"], kinds), histogram.cumulative_share(by, "mitigation", ["ptr_bounds", "subobject", "other", "unmitigated"], "n")


def annotated_trace(records: DataFrame, thread: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(readable lines, indented by depth; the graph of transitions).

    records: op (enter or leave), address, compartment, symbol, caller; compartments go by their file's name.
    """
    deep = trace.nesting(records, thread, order, F.col("op") == "enter")
    place = basename(F.col("compartment"))
    text = F.concat_ws(" ", F.trim(F.concat_ws(" ", F.coalesce(decimal_to_hex(F.col("address")), F.lit("")), F.upper("op"))), F.concat_ws(":", place, "symbol"))
    lines = deep.select(*thread, "seq", "depth", F.concat(F.repeat(F.lit("  "), F.greatest("depth", F.lit(0)).cast("int")), text).alias("value"))
    calls = records.where("op = 'enter'").groupBy(basename(F.col("caller")).alias("caller"), place.alias("callee")).agg(F.count("*").alias("n"))
    return lines, trace.call_graph(calls)


def instruction_difference(tables: Mapping[str, DataFrame], baseline: str) -> DataFrame:
    """Instructions and calls by symbol and target, each against the baseline."""
    every = None
    for target, df in tables.items():
        rows = df.select("symbol", F.lit(target).alias("target"), "n")
        every = rows if every is None else every.unionByName(rows)
    return trace.baseline_difference(every.groupBy("symbol", "target").agg(F.sum("n").alias("n")), ["symbol"], "target", baseline, ["n"])


def region_memory(spark: SparkSession, regions: str, records: DataFrame) -> DataFrame:
    return intervals.region_traffic(records, readers.read_regions(spark, regions))


def annotation_table(counts: DataFrame, components: Mapping[str, str], patterns: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Marks by component and pattern, with a total row."""
    from runledger.functions.scalars import first_match

    named = shape.drop_matching(counts, "file", skip).withColumn("component", first_match(F.col("file"), components))
    return shape.pivot_with_total(named, "component", "pattern", patterns, "n")


def annotation_tags(notes: DataFrame, known: DataFrame) -> DataFrame:
    """Files by tag, in percent of annotated files and of all."""
    total = known.select("name").distinct().count()
    kept = notes.join(known.select("name").distinct(), "name")
    changed = kept.groupBy().agg(F.count_distinct("name").alias("_n"))
    tags = kept.select("name", F.explode(F.array_union("changes", "changes_purecap")).alias("tag")).groupBy("tag").agg(F.count_distinct("name").alias("files"))
    return tags.crossJoin(F.broadcast(changed)).select("tag", "files", (F.col("files") * 100 / F.col("_n")).alias("of_changed"), F.try_divide(F.col("files") * 100, F.lit(total)).alias("of_all"))


def counters_per_request(counters: DataFrame, rates: DataFrame, keys: Sequence[str] = ("dataset_id", "iteration")) -> DataFrame:
    """Counters per message and per byte, on the runs and iterations that both have."""
    # Bytes are those of a message's request and response, where their sizes are known.
    sizes = [c for c in ("req_size", "resp_size") if c in rates.columns]
    joined = counters.join(rates.select(*keys, "message_count", *sizes), list(keys))
    out = joined.withColumn("per_message", F.try_divide("value", "message_count"))
    if sizes:
        out = out.withColumn("per_byte", F.try_divide("value", F.col("message_count") * sum((F.col(c) for c in sizes), F.lit(0))))
    return out.drop(*sizes)


def request_metrics(counters: DataFrame, rates: DataFrame, groups: Sequence[str], only: Sequence[str] = (), keys: Sequence[str] = ("dataset_id", "iteration")) -> DataFrame:
    """groups, metric, value: counter ratios and counters per message and per byte in long form, as means over iterations.

    Every run and iteration must have both counters and rates. `only` keeps some metrics; one whose inputs are not there is left out.
    """
    both = counters.select(*keys).distinct().withColumn("_c", F.lit(1)).join(rates.select(*keys).distinct().withColumn("_r", F.lit(1)), list(keys), "full")
    lost = both.where("_c is null or _r is null").take(3)
    if lost:
        raise ValueError(f"counters or rates are missing: {[tuple(r)[: len(keys)] for r in lost]}")
    known = [*dict.fromkeys([*keys, *groups])]
    each = counters_per_request(counters, rates, keys)
    kinds = [c for c in ("per_message", "per_byte") if c in each.columns]
    per = each.select(*known, F.explode(F.array(*[F.struct(F.concat_ws("_", "name", F.lit(c)).alias("metric"), F.col(c).alias("value")) for c in kinds])).alias("_m")).select(*known, "_m.metric", "_m.value")
    names = [m.name for m in shape.COUNTER_METRICS]
    ratios = shape.with_derived_metrics(counters, known, "name", "value").where(F.col("name").isin(names)).withColumnRenamed("name", "metric")
    rows = per.where("value is not null").unionByName(ratios)
    if only:
        rows = rows.where(F.col("metric").isin(list(only)))
    return rows.groupBy(*groups, "metric").agg(F.avg("value").alias("value"))


def touched_files(spark: SparkSession, paths: Sequence[str], root: str) -> DataFrame:
    return readers.read_strace_files(spark, list(paths), root).distinct()


def cache_miss_table(spark: SparkSession, path: str, section: str, **name: str) -> DataFrame:
    return readers.read_cache_reports(spark, path, section, **name).select("size", "size_text", "miss_rate").orderBy("size")


def packet_statistics(before: DataFrame, after: DataFrame, baseline: Mapping, run: Sequence[str]) -> DataFrame:
    """Work of each protocol against the baseline run."""
    delta = align.before_after(before, after, [*run, "workstream", "cpu", "name"], list(readers.NETISR_FIELDS))
    return compare.quartile_deltas(delta, "handled", baseline, ["name"], run)


def function_trace(calls: DataFrame, markers: DataFrame, symbols: DataFrame, run: Sequence[str]) -> DataFrame:
    """Statistics per function over the iterations that markers cut: calls (run, ts, pc, space, n)."""
    inside = intervals.with_iteration(calls, intervals.iteration_windows(markers, calls, run, "ts"), run, "ts")
    sums = inside.groupBy(*run, "iteration", "space", "pc").agg(F.sum("n").alias("n"))
    named = intervals.resolve_symbols(sums, symbols, "pc", "space", "addr", "name")
    return trace.function_statistics(named, [*run, "iteration"], ["name"], "n")
