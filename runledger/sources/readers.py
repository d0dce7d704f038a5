"""Readers of result files: one function per format, each with its schema; none infers types.

Paths may be globs. Readers give a row per file (or line, or entry) with the file's path in `file`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runledger.functions.scalars import hex_to_decimal, normal_path, ordered_address, snake_case, text_to_bytes
from runledger.operators.align import before_after
from runledger.sources import splits


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, **options: str) -> DataFrame:
    """CSV, also gzipped, with a header."""
    return spark.read.options(header=True, **options).schema(schema).csv(path).select("*", _file())


def read_json(spark: SparkSession, path: str | Sequence[str], schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines).select("*", _file())


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By suffix: .csv, .csv.gz or .json."""
    if path.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema)
    if path.endswith(".json"):
        return read_json(spark, path, schema)
    raise ValueError(f"unknown format: {path}")


def read_runs(spark: SparkSession, path: str, schema: str, runs: DataFrame, iteration: str = r"/iteration[-_]?([0-9]+)", dataset: str = r"/([0-9a-f-]{36})/") -> DataFrame:
    """Files of many runs and iterations, which are read from their paths; -1 where a path has no iteration."""
    return keyed_by_path(read_table(spark, path, schema), runs, iteration, dataset)


def keyed_by_path(data: DataFrame, runs: DataFrame, iteration: str, dataset: str) -> DataFrame:
    """Rows with the axes of their run, whose id is in the path, and its iteration; an unknown run raises."""
    found = F.regexp_extract("file", iteration, 1)
    keyed = data.withColumns({"dataset_id": F.regexp_extract("file", dataset, 1), "iteration": F.when(found == "", -1).otherwise(found.try_cast("int"))})
    lost = keyed.select("dataset_id").distinct().join(runs, "dataset_id", "left_anti").take(3)
    if lost:
        raise ValueError(f"files of unknown runs: {[r[0] for r in lost]}")
    return keyed.join(runs, "dataset_id")


#: Runs up to which a selection is put into the scan as a list; a larger one prunes folders while the query runs.
LISTED_RUNS = 10_000


def read_run_store(spark: SparkSession, root: str, schema: str, runs: DataFrame) -> DataFrame:
    """Rows of the given runs from folders dataset_id=<id>/iteration=<n> of Parquet files, with the axes of their run.

    Folders of other runs are not read: the ids of up to LISTED_RUNS runs are a filter of the scan, those of more are
    joined to the partition column.
    """
    data = spark.read.schema(f"{schema}, dataset_id string, iteration int").parquet(root)
    ids = [r[0] for r in runs.select("dataset_id").distinct().limit(LISTED_RUNS + 1).collect()]
    if len(ids) <= LISTED_RUNS:
        data = data.where(F.col("dataset_id").isin(ids))
    return data.join(runs, "dataset_id")


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).select("value", _file())


# -- timings -------------------------------------------------------------------------------------


def read_posix_time(spark: SparkSession, path: str) -> DataFrame:
    """real, user and sys lines -> times, user, sys."""
    parts = _lines(spark, path).select("file", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    value = F.get("p", F.lit(1)).cast("double")
    return parts.groupBy("file").agg(*[F.max(F.when(F.get("p", F.lit(0)) == k, value)).alias(n) for k, n in (("real", "times"), ("user", "user"), ("sys", "sys"))])


def read_hyperfine(spark: SparkSession, path: str) -> DataFrame:
    """The first result's time; several times or a failed command raise."""
    schema = "results array<struct<times:array<double>,exit_codes:array<int>,user:double,system:double>>"
    first = read_json(spark, path, schema).select("file", F.col("results")[0].alias("r"))
    good = (F.size("r.times") == 1) & ~F.coalesce(F.exists("r.exit_codes", lambda c: c != 0), F.lit(False))
    time = F.when(good, F.col("r.times")[0]).otherwise(F.raise_error(F.concat(F.lit("not one successful time: "), F.col("file"))).cast("double"))
    return first.select("file", time.alias("times"), F.col("r.user").alias("user"), F.col("r.system").alias("sys"))


# -- network -------------------------------------------------------------------------------------

_SUM = "struct<seconds:double,bytes:bigint,bits_per_second:double,jitter_ms:double,packets:bigint,lost_packets:bigint,lost_percent:double>"


def read_iperf(spark: SparkSession, path: str, udp: bool = False) -> DataFrame:
    """A sender and a receiver row per file; a file with an error raises."""
    schema = f"error string, start struct<sndbuf_actual:bigint,rcvbuf_actual:bigint,test_start:struct<blksize:bigint>>, end struct<sum_sent:{_SUM},sum_received:{_SUM},sum:{_SUM}>"
    data = read_json(spark, path, schema)
    sides = F.explode(F.array(F.struct(F.lit("sender").alias("side"), F.col("end.sum_sent").alias("s")), F.struct(F.lit("receiver").alias("side"), F.col("end.sum_received").alias("s"))))
    rows = data.where(F.col("error").isNull() | F.raise_error(F.concat(F.lit("iperf: "), "error")).cast("boolean"))
    extra = ("jitter_ms", "packets", "lost_packets", "lost_percent") if udp else ()
    out = rows.select("file", "start", F.col("end.sum").alias("all"), sides.alias("x"))
    named = [F.col("x.s")[c].alias(c) for c in ("seconds", "bytes", "bits_per_second")]
    lost = [F.coalesce(F.col("x.s")[c], F.col("all")[c]).alias(c) for c in extra]
    return out.select("file", "x.side", *named, *lost, F.col("start.sndbuf_actual").alias("sndbuf"), F.col("start.rcvbuf_actual").alias("rcvbuf"), F.col("start.test_start.blksize").alias("blksize"))


QPS_FIELDS = ("qps", "messageCount", "elapsedTime", "latency50", "latency90", "latency95", "latency99", "latency999")


def read_qps(spark: SparkSession, path: str) -> DataFrame:
    """Summary in snake case; request and response sizes, 0 where they are not given."""
    fields = ",".join(f"{f}:double" for f in QPS_FIELDS)
    schema = f"summary struct<{fields}>, scenario struct<clientConfig:struct<payloadConfig:struct<simpleParams:struct<reqSize:bigint,respSize:bigint>>>>"
    params = "scenario.clientConfig.payloadConfig.simpleParams"
    sizes = [F.coalesce(F.col(f"{params}.{a}"), F.lit(0)).alias(b) for a, b in (("reqSize", "req_size"), ("respSize", "resp_size"))]
    return read_json(spark, path, schema).select("file", *[F.col(f"summary.{f}").alias(snake_case(f)) for f in QPS_FIELDS], *sizes)


def read_redis(spark: SparkSession, path: str) -> DataFrame:
    """Rows with has_errors, whether any row of the file has an error."""
    data = read_csv(spark, path, "requests_per_second double, latency_ms double, errors bigint, connections bigint")
    bad = data.groupBy("file").agg(F.bool_or(F.coalesce(F.col("errors") != 0, F.lit(False))).alias("has_errors"))
    return data.join(bad, "file")


def read_wrk(spark: SparkSession, path: str) -> DataFrame:
    """One row per report; errors are failed responses. The request size comes from a scenario name that ends in _<n>b; another raises."""
    latency = ("min", "max", "mean", "std", "percentile50", "percentile90", "percentile95", "percentile99", "percentile999")
    schema = f"scenario string, summary struct<duration:double,requests:bigint,bytes:bigint>, errors struct<status:bigint>, latency struct<{','.join(f'{x}:double' for x in latency)}>"
    named = F.coalesce("scenario", F.regexp_replace("file", r"\.json$", ""))
    size = F.regexp_extract(named, r"_(\d+)b$", 1)
    known = F.when(size == "", F.raise_error(F.concat(F.lit("no request size in "), named)).cast("bigint")).otherwise(size.try_cast("bigint"))
    return read_json(spark, path, schema).select(
        "file", "scenario", "summary.*", F.col("errors.status").alias("errors"),
        *[F.col(f"latency.{x}").alias(f"latency_{x}") for x in latency], (F.col("summary.requests") * 1e6 / F.col("summary.duration")).alias("requests_per_second"), known.alias("request_size"),
    )


def read_netperf(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """CSV below one banner row; columns are chosen by name, in lower case, as doubles where they are numbers."""
    names, cells = F.split("header", ","), F.split("value", ",")
    told = F.map_from_arrays(names, F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.size(names))), F.lit(1), F.size(names)))
    rows = splits.below_header(spark, path).select("file", told.alias("m"))
    return rows.select("file", *[F.trim(F.try_element_at("m", F.lit(f))).try_cast("double").alias(f.lower()) for f in fields])


# -- counters and traces -------------------------------------------------------------------------


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counter samples, added up: file, cpu (null per process), name, value. The header has p/NAME or s/<cpu>/NAME."""
    # Lines of one file are samples; only the header has to be known to all of them.
    lines = _lines(spark, path)
    heads = lines.where("value like '#%'").groupBy("file").agg(F.min("value").alias("head")).select("file", F.filter(F.split(F.regexp_replace("head", "^#", ""), r"\s+"), lambda x: x.rlike("^[ps]/")).alias("names"))
    samples = lines.where("value not like '#%' and trim(value) <> ''").select("file", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("k", "v"))
    sums = samples.groupBy("file", "k").agg(F.sum(F.col("v").cast("double")).alias("value"))
    named = heads.select("file", F.posexplode("names").alias("k", "name"))
    parts = F.split("name", "/")
    return sums.join(named, ["file", "k"]).select("file", F.when(F.size(parts) == 3, F.element_at(parts, 2).try_cast("int")).alias("cpu"), F.lower(F.element_at(parts, -1)).alias("name"), "value")


def read_counters_series(spark: SparkSession, path: str, pattern: str = r"([0-9]+)[^0-9/]*$") -> DataFrame:
    """Counter files numbered from 1 in their names; iterations count from 0."""
    return read_counters(spark, path).withColumn("iteration", F.regexp_extract("file", pattern, 1).cast("int") - 1)


def read_callgraph(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Folded stacks of call-graph reports, one stack for each leaf, the leaf first; a large report is read by many tasks.

    Equal stacks of a file are added up. A line of another form raises.
    """
    return splits.call_graphs(spark, path)


def read_sysctl(spark: SparkSession, path: str) -> DataFrame:
    """name=value; the value may hold more signs."""
    return _lines(spark, path).where("value like '%=%'").select("file", F.trim(F.substring_index("value", "=", 1)).alias("sysctl_name"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("sysctl_value"))


def parse_transitions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Compartment transitions of trace lines, batch or streaming; other lines are left out."""
    form = r"^\s*(\d+)\s.*RTLD: c18n: (\S+) -> (\S+) at \[(\d+)\] (\S+)"
    take = lambda k: F.regexp_extract(column, form, k)
    rest = [c for c in lines.columns if c != column]
    return lines.where(F.col(column).rlike(form)).select(*rest, take(1).cast("bigint").alias("pid"), take(2).alias("caller"), take(3).alias("callee"), take(4).cast("bigint").alias("symbol_number"), take(5).alias("symbol"))


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return parse_transitions(_lines(spark, path))


def parse_instructions(lines: DataFrame, column: str = "value", rejects: Observation | None = None) -> DataFrame:
    """Executed instructions of trace lines: cpu, pc, address, opcode, mnemonic, operands; lines of other forms are left out.

    address is pc as a whole number in the order of unsigned ones (scalars.ordered_address). rejects observes how many of these
    begin like an instruction, as `rejected`.
    """
    form = r"^\[(\d+):(\d+)\]\s+(?:0x)?([0-9a-fA-F]+):\s+(?:0x)?([0-9a-fA-F]+)\s+(\S+)\s*(.*)$"
    rest = [c for c in lines.columns if c != column]
    if rejects is not None:
        lines = lines.observe(rejects, F.count_if(F.col(column).rlike(r"^\[\d+:\d+\]") & ~F.col(column).rlike(form)).alias("rejected"))
    # One match gives all fields; none of them can hold a line feed.
    fields = F.split(F.regexp_replace(column, form, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    told = lines.where(F.col(column).rlike(form)).select(*rest, fields.alias("_fields"))
    take = lambda k: F.get("_fields", F.lit(k - 1))
    return told.select(*rest, take(1).cast("int").alias("cpu"), take(2).cast("bigint").alias("line"), hex_to_decimal(take(3)).alias("pc"), ordered_address(take(3)).alias("address"), take(4).alias("opcode"), take(5).alias("mnemonic"), F.trim(take(6)).alias("operands"))


def read_instructions(spark: SparkSession, path: str, rejects: Observation | None = None) -> DataFrame:
    return parse_instructions(_lines(spark, path), rejects=rejects)


def read_symbols(spark: SparkSession, path: str, base: int = 0, sized: bool = True) -> DataFrame:
    """POSIX symbol listings: name, type, hexadecimal address and size, space-separated."""
    p = F.split(F.trim("value"), r"\s+")
    kinds = F.when(F.upper(F.get(p, F.lit(1))) == "T", "FUNC").when(F.upper(F.get(p, F.lit(1))) == "D", "OBJECT").otherwise("OTHER")
    rows = _lines(spark, path).where(F.size(p) >= (4 if sized else 3))
    return rows.select("file", F.get(p, F.lit(0)).alias("name"), kinds.alias("kind"), (hex_to_decimal(F.get(p, F.lit(2))) + F.lit(base)).alias("addr"), (hex_to_decimal(F.get(p, F.lit(3))) if sized else F.lit(None).cast("decimal(20,0)")).alias("size"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """name, start, end or +length, in hexadecimal with 0x or in decimals; bad lines are left out."""
    p = F.transform(F.split("value", ","), lambda x: F.trim(x))
    number = lambda x: F.when(x.rlike("^0[xX]"), hex_to_decimal(x)).otherwise(x.try_cast("decimal(20,0)"))
    rows = _lines(spark, path).select(p.alias("p")).where(F.size("p") == 3)
    start, end = number(F.get("p", F.lit(1))), number(F.regexp_replace(F.get("p", F.lit(2)), r"^\+", ""))
    named = rows.select(F.get("p", F.lit(0)).alias("name"), start.alias("start"), F.when(F.get("p", F.lit(2)).startswith("+"), start + end).otherwise(end).alias("end"))
    return named.where("start is not null and end is not null and end > start").orderBy("start", "end", "name")


def read_process_map(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace columns PID START END PRT RES PRES REF SHD FLAG TP PATH."""
    p = F.split(F.trim("value"), r"\s+", 11)
    rows = _lines(spark, path).where(F.get(p, F.lit(0)).rlike("^[0-9]+$"))
    return rows.select("file", F.get(p, F.lit(0)).cast("bigint").alias("pid"), hex_to_decimal(F.get(p, F.lit(1))).alias("start"), hex_to_decimal(F.get(p, F.lit(2))).alias("end"), F.get(p, F.lit(3)).alias("prt"), F.get(p, F.lit(10)).alias("path"))


def mapped_binaries(maps: DataFrame) -> DataFrame:
    """Where each binary of a process begins."""
    return maps.where("coalesce(path, '') <> ''").groupBy("pid", "path").agg(F.min("start").alias("start"))


# -- code ----------------------------------------------------------------------------------------

_CODE = "map<string,struct<code:int>>"


def read_cloc(spark: SparkSession, path: str) -> DataFrame:
    """Lines of code by file."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _CODE)).alias("name", "v"), _file())
    return files.where(~F.col("name").isin("header", "SUM")).select("file", "name", F.col("v.code").alias("code"))


CLOC_PARTS = ("added", "modified", "removed", "same")


def read_cloc_diff(spark: SparkSession, path: str) -> DataFrame:
    """Lines added, modified, removed and kept by file; 0 where a part lacks the file."""
    parts = spark.read.text(path, wholetext=True).select(F.from_json("value", ", ".join(f"{p} {_CODE}" for p in CLOC_PARTS)).alias("d"), _file())
    none = F.array().cast("array<string>")
    names = F.array()
    for p in CLOC_PARTS:
        names = F.array_union(names.cast("array<string>"), F.coalesce(F.map_keys(f"d.{p}"), none))
    rows = parts.select("file", "d", F.explode(names).alias("name"))
    return rows.select("file", "name", *[F.coalesce(F.try_element_at(f"d.{p}", F.col("name"))["code"], F.lit(0)).alias(p) for p in CLOC_PARTS])


def read_compilation_db(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "file_name string").select(normal_path(F.col("file_name")).alias("name")).dropDuplicates(["name"])


def read_strace_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """C, header and assembly files below a root that were opened, relative to it."""
    name = F.regexp_extract("value", r'openat\([^"]*"([^"]+\.[chS])"', 1)
    base = root.rstrip("/") + "/"
    return _lines(spark, path).select(normal_path(name).alias("name")).where(F.startswith("name", F.lit(base))).select(F.expr(f"substring(name, {len(base) + 1})").alias("name")).distinct()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Records of annotated files, one JSON document per line: name, updates, changes, changes_purecap, hybrid_specific."""
    schema = "file string, updates array<string>, changes array<string>, changes_purecap array<string>, hybrid_specific boolean"
    data = spark.read.schema(schema).json(path)
    none = F.array().cast("array<string>")
    return data.select(normal_path(F.col("file")).alias("name"), *[F.coalesce(c, none).alias(c) for c in ("updates", "changes", "changes_purecap")], F.coalesce("hybrid_specific", F.lit(False)).alias("hybrid_specific"))


def scan_sources(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Lines of each file below a folder that match each pattern: pattern, file, n."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", _file())
    hits = F.filter(F.array(*[F.when(F.col("value").rlike(p), name) for name, p in patterns.items()]), F.isnotnull)
    return lines.select("file", F.explode(hits).alias("pattern")).groupBy("pattern", "file").agg(F.count("*").alias("n"))


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Bounds statistics of kernel and modules; names of unknown origin become null, the module comes from the folder."""
    schema = "alignment_bits string, size string, kind string, source_loc string, compiler_pass string, details string"
    data = read_csv(spark, path, schema)
    clean = lambda c: F.when(F.col(c).rlike("^<unknown"), None).otherwise(F.col(c))
    return data.select(F.col("alignment_bits").try_cast("bigint").alias("alignment_bits"), F.col("size").try_cast("bigint").alias("size"), "kind", clean("source_loc").alias("source_loc"), "compiler_pass", clean("details").alias("details"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("src_module"))


#: What an advisory is about, and what mitigates it.
ADVISORY_KINDS = ("memory_safety", "uaf", "race")
ADVISORY_MITIGATIONS = ("ptr_bounds", "subobject", "unmitigated")


def read_advisories(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Advisories with their year; a flag that is not given is false."""
    flags = [*[f"kind_{k}" for k in ADVISORY_KINDS], *[f"mitigation_{m}" for m in ADVISORY_MITIGATIONS]]
    data = read_json(spark, path, "name string, date string, " + ", ".join(f"{f} boolean" for f in flags), lines)
    date = F.to_timestamp("date", "yyyy-MM-dd HH:mm:ss")
    return data.select("file", "name", date.alias("date"), F.year(date).alias("year"), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def read_cache_reports(spark: SparkSession, path: str, section: str, name: str = r"([0-9]+[KMG])[^/]*$") -> DataFrame:
    """The first miss rate below a section heading, and the cache size in the file's path (K, M, G), in its name if not said else."""
    found = splits.first_below(spark, path, section, r"miss rate:\s*([0-9.]+)%")
    size = F.regexp_extract("file", name, 1)
    return found.select("file", size.alias("size_text"), text_to_bytes(F.when(size != "", size)).alias("size"), F.col("found").try_cast("double").alias("miss_rate")).orderBy("size")


# -- snapshots -----------------------------------------------------------------------------------


def read_malloc(spark: SparkSession, path: str) -> DataFrame:
    schema = "`malloc-statistics` struct<memory:array<struct<type:string,`in-use`:bigint,`memory-use`:bigint,requests:bigint,size:array<bigint>>>>"
    return read_json(spark, path, schema).select("file", F.explode("malloc-statistics.memory").alias("m")).select("file", "m.type", F.col("m.in-use").alias("in_use"), F.col("m.memory-use").alias("memory_use"), "m.requests", "m.size")


def malloc_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change by type; new_sizes are size classes that only the later snapshot has."""
    delta = before_after(before, after, ["type"], ["in_use", "memory_use", "requests"])
    sizes = before.select("type", F.col("size").alias("_b")).join(after.select("type", F.col("size").alias("_a")), "type")
    return delta.join(sizes.select("type", F.array_except("_a", "_b").alias("new_sizes")), "type")


ZONE_FIELDS = ("used", "free", "requests", "fail")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    fields = ",".join(f"{f}:bigint" for f in ("size", "limit", *ZONE_FIELDS))
    return read_json(spark, path, f"`memory-zone-statistics` struct<zone:array<struct<name:string,{fields}>>>").select("file", F.explode("memory-zone-statistics.zone").alias("z")).select("file", "z.*")


def zone_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change by zone; the item size is that of the earlier snapshot."""
    return before_after(before, after, ["name"], list(ZONE_FIELDS), keep=["size"])


def zone_info(zones: DataFrame, nodes: DataFrame) -> DataFrame:
    """Zones with their bucket size and pages from node:value pairs (node, value); 0 where there are none."""
    parts = F.split("node", r"\.")
    picked = nodes.where(F.col("node").rlike(r"\.bucket_size$|\.keg\.")).select(F.element_at(parts, 3).alias("zone"), F.element_at(parts, -1).alias("field"), F.col("value").try_cast("bigint").alias("v"))
    wide = picked.groupBy("zone").pivot("field", ["bucket_size", "ppera", "ipers"]).agg(F.max("v"))
    return zones.withColumn("zone", F.regexp_replace("name", "[^A-Za-z0-9]", "_")).join(wide, "zone", "left").na.fill(0, ["bucket_size", "ppera", "ipers"])


NETISR_FIELDS = ("dispatched", "hybrid_dispatched", "queued", "handled", "queue_drops")


def read_netisr(spark: SparkSession, path: str) -> DataFrame:
    work = "array<struct<workstream:bigint,cpu:bigint,name:string,length:bigint,watermark:bigint,dispatched:bigint,`hybrid-dispatched`:bigint,queued:bigint,handled:bigint,`queue-drops`:bigint>>"
    data = read_json(spark, path, f"netisr struct<workstream:array<struct<work:{work}>>>")
    rows = data.select("file", F.explode("netisr.workstream").alias("s")).select("file", F.explode("s.work").alias("w")).select("file", "w.*")
    return rows.withColumnsRenamed({"hybrid-dispatched": "hybrid_dispatched", "queue-drops": "queue_drops"})


def netisr_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return before_after(before, after, ["workstream", "cpu", "name"], list(NETISR_FIELDS))


def read_pid_map(spark: SparkSession, path: str) -> DataFrame:
    """pid, tid and names of created processes and threads."""
    schema = "create array<struct<pid:bigint,name:string>>, `thr-create` array<struct<pid:bigint,tid:bigint,name:string>>"
    return pid_names(read_json(spark, path, schema))


def pid_names(data: DataFrame) -> DataFrame:
    """Reports of created processes and threads, joined on the process."""
    process = data.select("file", F.explode("create").alias("p")).select("file", "p.pid", F.col("p.name").alias("process"))
    thread = data.select("file", F.explode("thr-create").alias("t")).select("file", "t.pid", "t.tid", F.col("t.name").alias("thread"))
    return process.join(thread, ["file", "pid"])


# -- stores --------------------------------------------------------------------------------------


def read_layouts(spark: SparkSession, folder: str, columns: Sequence[str] = (), types: Mapping[str, str] | None = None, where: Column | None = None) -> DataFrame:
    """Members with their structure and binary, from the three tables of a layout store as Parquet.

    columns: those wanted, in order; types: casts of some of them; where: rows wanted, by any column of the store.
    """
    binary, layout, member = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("binary", "type_layout", "layout_member"))
    b = binary.select(F.col("id").alias("binary_id"), F.col("file").alias("binary"))
    flags = [c for c in ("is_union", "has_vla") if c in layout.columns]
    s = layout.select(F.col("id").alias("owner"), F.col("file").alias("src_file"), "line", F.col("name").alias("struct"), F.col("size").alias("struct_size"), "binary_id", *flags)
    joined = member.join(s, "owner").join(b, "binary_id")
    joined = joined if where is None else joined.where(where)
    joined = joined.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})
    return joined.select(*columns) if columns else joined


def _during(since: int | None, until: int | None) -> Column:
    """ts in [since, until); None is no bound."""
    span: Column = F.lit(True)
    if since is not None:
        span = span & (F.col("ts") >= since)
    return span if until is None else span & (F.col("ts") < until)


def read_track(spark: SparkSession, folder: str, track: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Slices of a track with their arguments, or counter values, inside [since, until)."""
    span = _during(since, until)
    if track == "slice":
        slices = spark.read.parquet(f"{folder}/slice.parquet").where(span)
        args = spark.read.parquet(f"{folder}/args.parquet").groupBy("arg_set_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("args"))
        return slices.join(args, "arg_set_id", "left")
    counters = spark.read.parquet(f"{folder}/counter.parquet").where(span)
    return counters.join(spark.read.parquet(f"{folder}/counter_track.parquet").where(F.col("name") == track), "track_id")


def read_counter_slots(spark: SparkSession, folder: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Counter values of all tracks: name and slot from a track's name, name:slot, and ts since the beginning of the range."""
    values = spark.read.parquet(f"{folder}/counter.parquet").where(_during(since, until))
    tracks = spark.read.parquet(f"{folder}/counter_track.parquet").select("track_id", F.split("name", ":").alias("_n"))
    return values.join(tracks, "track_id").select((F.col("ts") - F.lit(since or 0)).alias("ts"), F.col("_n")[0].alias("name"), F.get("_n", F.lit(1)).try_cast("int").alias("slot"), "value")


def read_contexts(spark: SparkSession, folder: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Intervals of context tracks with their process, thread and compartment: pid, tid, cid, el, ts, start, end, value."""
    part = lambda t, *columns: spark.read.parquet(f"{folder}/{t}.parquet").select(*columns)
    tracks = part("context_track", "track_id", "upid", "utid", "ucid").join(part("process", "upid", "pid"), "upid").join(part("thread", "utid", "tid"), "utid").join(part("compartment", "ucid", "cid", "el"), "ucid")
    return spark.read.parquet(f"{folder}/interval.parquet").where(_during(since, until)).join(tracks, "track_id").select("pid", "tid", "cid", "el", "ts", "start", "end", "value")


#: Fixed value: the statistic that counts lost packets of a trace.
PACKET_LOSS = "traced_buf_trace_writer_packet_loss"


def lost_packets(spark: SparkSession, folder: str) -> int:
    """Packets that a trace has lost; a trace that doesn't say it once raises."""
    rows = spark.read.parquet(f"{folder}/stats.parquet").where(F.col("name") == PACKET_LOSS).select("value").take(2)
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} statistics {PACKET_LOSS}")
    return int(rows[0][0])
