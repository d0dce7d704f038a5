"""Stores, listings and snapshots: tables written in the form that a tool leaves, read back and reported on."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import align, compare, coords, intervals, layouts, shape, trace
from runledger.plans import pipelines
from runledger.plans.files import FLAGS, SUMS_SQL, files, overhead_sql, point, run_id, runs_of, sums, text_of
from runledger.plans.registry import query
from runledger.plans.views import MEMBERS_SQL, members, table
from runledger.session import fresh_path, stored
from runledger.sources import readers, sinks

# -- code ----------------------------------------------------------------------------------------

_CODE_SQL = "c AS (SELECT l_linestatus, 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.c' AS name, count(*) AS added, sum(l_linenumber)::BIGINT AS same FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _code(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".c"))
    counts = lines.groupBy("l_linestatus", name.alias("name")).agg(F.count("*").alias("added"), F.sum("l_linenumber").alias("same"))
    return stored(counts.withColumns({"dataset_id": run_id("l_linestatus"), "iteration": F.lit(0)}), "code")


def _by_file(column: str):
    entries = F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.col(column).cast("int").alias("code")))))
    return entries


@query("line_count_files", f"WITH {_CODE_SQL} SELECT l_linestatus, name, added AS code FROM c")
def line_count_files(spark, sf_dir):
    """Lines of code by file; the report's header and sum are no files."""
    rows = _code(spark, sf_dir)
    extra = F.map_from_arrays(F.array(F.lit("header"), F.lit("SUM")), F.array(F.struct(F.lit(0).alias("code")), F.struct(F.sum("added").cast("int").alias("code"))))
    reports = rows.groupBy("dataset_id", "iteration").agg(F.to_json(F.map_concat(_by_file("added"), extra)).alias("content"))
    return pipelines.with_runs(readers.read_cloc(spark, files(reports, F.col("content"), "cloc")), runs_of(rows, ["l_linestatus"])).select("l_linestatus", "name", F.col("code").cast("long").alias("code"))


@query(
    "code_churn",
    f"""WITH {_CODE_SQL}, k AS (SELECT *, CASE WHEN name LIKE 'src/promo/%' THEN 'promo' WHEN name LIKE '%widget.c' THEN 'widgets' ELSE 'other' END AS component FROM c WHERE name NOT LIKE 'src/small/%' AND name IN (SELECT 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.c' FROM part WHERE p_size > 20)),
    b AS (SELECT component, sum(added + same) AS lines FROM k WHERE l_linestatus = 'O' GROUP BY 1), r AS (SELECT l_linestatus, component, sum(added + same)::BIGINT AS code, count(DISTINCT name) AS file FROM k GROUP BY 1, 2)
    SELECT l_linestatus, component, code, file, round(code * 100.0 / lines, 6) AS code_pct, round(file * 100.0 / lines, 6) AS file_pct_of_lines FROM r LEFT JOIN b USING (component)""",
)
def code_churn(spark, sf_dir):
    """Lines added and kept by component, of files that the build names, in percent of the baseline's."""
    rows = _code(spark, sf_dir)
    parts = F.struct(*[(_by_file(p) if p in ("added", "same") else F.lit(None).cast("map<string,struct<code:int>>")).alias(p) for p in readers.CLOC_PARTS])
    reports = rows.groupBy("dataset_id", "iteration").agg(F.to_json(parts).alias("content"))
    lines = pipelines.with_runs(readers.read_cloc_diff(spark, files(reports, F.col("content"), "diff")), runs_of(rows, ["l_linestatus"]))
    build = fresh_path(spark, "build")
    name = F.concat(F.lit("./src/"), F.lower("p_type"), F.lit("/../"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".c"))
    sinks.write_csv(table(spark, sf_dir, "part").where("p_size > 20").select(name.alias("file_name")), build)
    code = lines.withColumn("code", (F.col("added") + F.col("modified") + F.col("removed") + F.col("same")).cast("long"))
    components = [shape.Component("widgets", pattern=r"widget\.c$"), shape.Component("promo", pattern="^src/promo/")]
    churn, _ = pipelines.code_churn(code, components, {"l_linestatus": "O"}, ["l_linestatus"], readers.read_compilation_db(spark, build), reject=["src/small/"])
    return churn.withColumns({c: F.round(c, 6) for c in ("code_pct", "file_pct_of_lines")})


@query("uncounted_files", f"WITH {_CODE_SQL} SELECT DISTINCT 'src/' || lower(p_type) || '/' || p_name || '.c' AS name FROM part WHERE 'src/' || lower(p_type) || '/' || p_name || '.c' NOT IN (SELECT name FROM c)")
def uncounted_files(spark, sf_dir):
    """Files of a build that no report counts: those whose names hold a space here."""
    rows = _code(spark, sf_dir).withColumn("code", F.col("added"))
    build = fresh_path(spark, "build")
    sinks.write_csv(table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "p_name", F.lit(".c")).alias("file_name")), build)
    return pipelines.code_churn(rows, [], {"l_linestatus": "O"}, ["l_linestatus"], readers.read_compilation_db(spark, build))[1].select("name")


@query("touched_files", "SELECT DISTINCT lower(p_type) || '/' || replace(p_brand, '#', '') || CASE WHEN p_size % 2 = 0 THEN '.c' ELSE '.h' END AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'")
def touched_files(spark, sf_dir):
    """Sources below a root that traces of system calls open; objects and files elsewhere are left out."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    root = F.when(F.col("l_returnflag") == "R", "/usr/include/").otherwise("/work/src/")
    end = F.when(F.col("p_size") % 2 == 0, ".c").otherwise(".h")
    path = F.concat(root, F.lit("./"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")))
    calls = F.explode(F.array(*[F.concat(F.lit('openat(AT_FDCWD, "'), path, e, F.lit('", O_RDONLY) = 3')) for e in (end, F.lit(".o"))]))
    folder = fresh_path(spark, "strace")
    sinks.write_text(lines.select(calls.alias("value")), folder)
    return pipelines.touched_files(spark, [folder], "/work/src")


@query(
    "annotation_counts",
    """
    WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, lang, 'license' AS pattern FROM l WHERE regexp_matches(line, '[Ll]icense') UNION ALL SELECT doc_id, lang, 'shout' FROM l WHERE regexp_matches(line, '!!')),
    s AS (SELECT CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS component, pattern, count(*) AS n FROM h GROUP BY ALL)
    SELECT component, coalesce(sum(n) FILTER (pattern = 'license'), 0)::BIGINT AS license, coalesce(sum(n) FILTER (pattern = 'shout'), 0)::BIGINT AS shout FROM (SELECT * FROM s UNION ALL SELECT 'Total', pattern, n FROM s) GROUP BY 1
    """,
)
def annotation_counts(spark, sf_dir):
    """Lines of a source tree that match each pattern, by component, with a total row."""
    path = fresh_path(spark, "tree")
    table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).where("value is not null").write.partitionBy("lang").text(path)
    counts = readers.scan_sources(spark, path, {"license": "[Ll]icense", "shout": "!!"})
    return pipelines.annotation_table(counts, {"english": "/lang=en/"}, ["license", "shout"])


@query(
    "annotation_tags",
    """
    WITH n AS (SELECT o_custkey AS k, unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders), c AS (SELECT count(DISTINCT o_custkey) AS changed FROM orders JOIN customer ON o_custkey = c_custkey), a AS (SELECT count(*) AS every FROM customer)
    SELECT tag, count(DISTINCT k) AS files, round(count(DISTINCT k) * 100.0 / changed, 6) AS of_changed, round(count(DISTINCT k) * 100.0 / every, 6) AS of_all FROM n JOIN customer ON c_custkey = k, c, a GROUP BY tag, changed, every
    """,
)
def annotation_tags(spark, sf_dir):
    """Records of annotated files, a null list counting as none: files by tag, of the changed ones and of all."""
    notes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("changes"), F.collect_set("o_orderpriority").alias("pure"))
    name = lambda c: F.concat(F.lit("sys/./kern/f"), F.col(c).cast("string"), F.lit(".c"))
    folder = fresh_path(spark, "notes")
    sinks.write_json(notes.select(name("o_custkey").alias("file"), F.lit(None).cast("array<string>").alias("updates"), "changes", F.col("pure").alias("changes_purecap")), folder)
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("sys/kern/f"), F.col("c_custkey").cast("string"), F.lit(".c")).alias("name"))
    tags = pipelines.annotation_tags(readers.read_annotations(spark, folder), known)
    return tags.select("tag", "files", *[F.round(c, 6).alias(c) for c in ("of_changed", "of_all")])


# -- snapshots -----------------------------------------------------------------------------------

#: Finished orders are the earlier snapshot, all others the later one.
_MOMENT_SQL = "CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'O' END"
_ZONES_SQL = f"z AS (SELECT {_MOMENT_SQL} AS moment, o_orderpriority AS name, count(*) AS used, sum(o_custkey)::BIGINT AS free, max(o_orderkey) AS requests, min(o_custkey) AS fail FROM orders GROUP BY ALL)"


def _zones(spark, sf_dir, moment=None):
    moment = F.expr(_MOMENT_SQL) if moment is None else F.lit(moment)
    zones = table(spark, sf_dir, "orders").groupBy(moment.alias("moment"), F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("used"), F.sum("o_custkey").alias("free"), F.max("o_orderkey").alias("requests"), F.min("o_custkey").alias("fail"))
    return stored(zones, "zones")


def _zone_snapshot(spark, zones, status, size):
    """A report of one snapshot's zones; a zone's size follows from the name's length."""
    path = fresh_path(spark, "zones")
    one = F.struct("name", (F.length("name") * size).alias("size"), F.lit(0).alias("limit"), *readers.ZONE_FIELDS)
    report = zones.where(F.col("moment") == status).agg(F.to_json(F.struct(F.struct(F.collect_list(one).alias("zone")).alias("memory-zone-statistics"))).alias("value"))
    sinks.write_text(report, path)
    return readers.read_zones(spark, path)


@query("zone_changes", f"WITH {_ZONES_SQL} SELECT name, a.used - b.used AS used, a.free - b.free AS free, a.requests - b.requests AS requests, a.fail - b.fail AS fail, length(name)::BIGINT AS size FROM z a JOIN z b USING (name) WHERE a.moment = 'O' AND b.moment = 'F'")
def zone_changes(spark, sf_dir):
    """Changes of zones between two snapshots, with the earlier one's item size."""
    zones = _zones(spark, sf_dir)
    return readers.zone_delta(_zone_snapshot(spark, zones, "F", 1), _zone_snapshot(spark, zones, "O", 3))


@query(
    "zone_information",
    f"WITH z AS (SELECT o_orderpriority AS name, count(*) AS used, sum(o_custkey)::BIGINT AS free FROM orders GROUP BY ALL) SELECT name, used, free, CASE WHEN name[1:1] IN ('1', '2', '3') THEN used * 2 ELSE 0 END AS bucket_size, CASE WHEN name[1:1] IN ('1', '2', '3') THEN free ELSE 0 END AS ppera, 0::BIGINT AS ipers FROM z",
)
def zone_information(spark, sf_dir):
    """Zones with what node listings say of them, 0 where they say nothing."""
    zones = _zones(spark, sf_dir, "O")
    path, clean = fresh_path(spark, "nodes"), F.regexp_replace("name", "[^A-Za-z0-9]", "_")
    open_ = zones.where("substring(name, 1, 1) in ('1', '2', '3')")
    node = lambda end, value: F.struct(F.concat(F.lit("vm.uma."), clean, F.lit(end)).alias("node"), value.cast("string").alias("value"))
    rows = open_.select(F.explode(F.array(node(".bucket_size", F.col("used") * 2), node(".keg.ppera", F.col("free")), node(".limit.items", F.col("fail")))).alias("n")).select("n.*")
    sinks.write_csv(rows, path)
    nodes = readers.read_csv(spark, path, "node string, value string")
    return readers.zone_info(_zone_snapshot(spark, zones, "O", 1), nodes).select("name", "used", "free", "bucket_size", "ppera", "ipers")


@query(
    "allocation_changes",
    f"WITH m AS (SELECT o_orderpriority AS type, {_MOMENT_SQL} AS s, count(*) AS in_use, sum(o_custkey)::BIGINT AS memory_use, max(o_orderkey) AS requests FROM orders GROUP BY ALL) SELECT type, a.in_use - b.in_use AS in_use, a.memory_use - b.memory_use AS memory_use, a.requests - b.requests AS requests, '64' AS new_sizes FROM m a JOIN m b USING (type) WHERE a.s = 'O' AND b.s = 'F'",
)
def allocation_changes(spark, sf_dir):
    """Changes of allocations by type, and the size classes that only the later snapshot has."""
    sums_ = table(spark, sf_dir, "orders").groupBy(F.expr(_MOMENT_SQL).alias("moment"), F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("m"), F.max("o_orderkey").alias("r"))
    sides = []
    for status, sizes in (("F", [16, 32]), ("O", [32, 64])):
        path = fresh_path(spark, "malloc")
        one = F.struct("type", F.col("n").alias("in-use"), F.col("m").alias("memory-use"), F.col("r").alias("requests"), F.array(*map(F.lit, sizes)).alias("size"))
        sinks.write_text(sums_.where(F.col("moment") == status).agg(F.to_json(F.struct(F.struct(F.collect_list(one).alias("memory")).alias("malloc-statistics"))).alias("value")), path)
        sides.append(readers.read_malloc(spark, path))
    return readers.malloc_delta(*sides).withColumn("new_sizes", F.array_join(F.col("new_sizes").cast("array<string>"), ","))


@query(
    "allocator_table",
    """
    WITH d AS (SELECT l_returnflag, l_shipmode AS name, used FROM (SELECT l_returnflag, year(l_shipdate)::VARCHAR AS l_shipmode, sum(l_quantity)::BIGINT - count(*) AS used FROM lineitem GROUP BY ALL)),
    m AS (SELECT * FROM d WHERE name IN (SELECT name FROM d GROUP BY 1 HAVING max(abs(used)) > 0 AND count(DISTINCT used) > 1)),
    s AS (SELECT m.l_returnflag, m.name, m.used - b.used AS delta FROM m LEFT JOIN m b ON b.l_returnflag = 'N' AND b.name = m.name),
    q AS (SELECT *, quantile_cont(abs(delta), 0.5) OVER (PARTITION BY l_returnflag) AS e FROM s)
    SELECT l_returnflag, name, delta::DOUBLE AS median_delta FROM q WHERE abs(delta) >= e QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(delta) DESC, name) <= 30
    """,
)
def allocator_table(spark, sf_dir):
    """Zones whose change over the baseline run is in the upper half (a top-k report)."""
    zones = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    side = lambda c: zones.select("l_returnflag", "name", F.lit(8).alias("size"), *[F.col(c).alias(f) for f in readers.ZONE_FIELDS])
    return pipelines.allocator_table(side("n"), side("q"), {"l_returnflag": "N"}, ["l_returnflag"], 0.5).select("l_returnflag", "name", "median_delta")


_WORK_SQL = f"{SUMS_SQL}, w AS (SELECT l_returnflag, l_linestatus AS name, iteration AS cpu, price - q AS handled FROM s)"


@query(
    "packet_statistics",
    f"WITH {_WORK_SQL}, t AS (SELECT name, l_returnflag, avg(handled) AS mean, median(handled) AS median FROM w GROUP BY ALL) SELECT t.name, t.l_returnflag, round(t.mean, 4) AS mean, round(t.mean - b.mean, 4) AS mean_delta, round((t.median - b.median) / b.median, 6) AS median_norm FROM t LEFT JOIN t b ON b.l_returnflag = 'N' AND b.name = t.name",
)
def packet_statistics(spark, sf_dir):
    """Work of each protocol over processors, from snapshots before and after, against the baseline run."""
    rows = sums(spark, sf_dir)
    sides = []
    for value in ("q", "price"):
        fields = {"dispatched": "n", "hybrid-dispatched": "n", "queued": "n", "handled": value, "queue-drops": "n"}
        work = F.struct(F.lit(0).alias("workstream"), F.col("iteration").alias("cpu"), F.col("l_linestatus").alias("name"), F.lit(1).alias("length"), F.lit(2).alias("watermark"), *[F.col(c).alias(k) for k, c in fields.items()])
        reports = rows.groupBy("l_returnflag").agg(F.to_json(F.struct(F.struct(F.array(F.struct(F.collect_list(work).alias("work"))).alias("workstream")).alias("netisr"))).alias("content"))
        reports = reports.withColumns({"dataset_id": run_id("l_returnflag"), "iteration": F.lit(0)})
        sides.append(pipelines.with_runs(readers.read_netisr(spark, files(reports, F.col("content"), "netisr")), runs_of(rows.withColumn("dataset_id", run_id("l_returnflag")), ["l_returnflag"])))
    out = pipelines.packet_statistics(*sides, {"l_returnflag": "N"}, ["l_returnflag"])
    return out.select("name", "l_returnflag", F.round("mean", 4).alias("mean"), F.round("mean_delta", 4).alias("mean_delta"), F.round("median_norm", 6).alias("median_norm"))


@query("mapped_binaries", "SELECT o_custkey AS pid, '/lib/' || o_orderstatus AS path, (min(o_orderkey) * 4096)::VARCHAR AS start FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL")
def mapped_binaries(spark, sf_dir):
    """Where each binary of a process begins; mappings without a path are left out."""
    low = F.concat(F.lit("0x"), F.lower(F.hex(F.col("o_orderkey") * 4096)))
    path = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit("/lib/"), "o_orderstatus"))
    folder = fresh_path(spark, "maps")
    lines = table(spark, sf_dir, "orders").select(F.array(F.struct(F.lit("PID START END PRT RES PRES REF SHD FLAG TP PATH").alias("value")), F.struct(text_of("%s %s 0xfff r-x 1 2 3 4 CN-- vn %s", "o_custkey", low, path).alias("value"))).alias("v"))
    sinks.write_text(lines.select(F.explode("v").alias("v")).select("v.value"), folder)
    return readers.mapped_binaries(readers.read_process_map(spark, folder)).select("pid", "path", F.col("start").cast("string").alias("start"))


@query("created_threads", "SELECT o_custkey AS pid, o_orderkey AS tid, c_name AS process, o_orderpriority AS thread FROM orders JOIN customer ON o_custkey = c_custkey")
def created_threads(spark, sf_dir):
    """Names of processes and threads, from one report for each process."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.array(F.struct(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"))).alias("create"))
    threads = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pid")).agg(F.collect_list(F.struct(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("tid"), F.col("o_orderpriority").alias("name"))).alias("thr-create"))
    folder = fresh_path(spark, "pids")
    # A line is a report: the file is not read as one document.
    sinks.write_json(names.join(threads, "pid").select("create", "thr-create"), folder)
    schema = "create array<struct<pid:bigint,name:string>>, `thr-create` array<struct<pid:bigint,tid:bigint,name:string>>"
    return readers.pid_names(readers.read_json(spark, folder, schema, lines=True)).select("pid", "tid", "process", "thread").distinct()


# -- instructions, regions -----------------------------------------------------------------------

_CODE_BASE = 0x40000


def _instruction_files(spark, sf_dir):
    """(symbol listing, folder of traces): parts are functions of size 4 * (1 + part size % 4), line items executed instructions."""
    symbols, traces = fresh_path(spark, "symbols"), fresh_path(spark, "instructions")
    part = table(spark, sf_dir, "part")
    addr, size = F.col("p_partkey") * 16 + _CODE_BASE, 4 * (1 + F.col("p_size") % 4)
    sinks.write_text(part.select(text_of("fn_%s T %s %s", "p_partkey", F.lower(F.hex(addr)), F.lower(F.hex(size))).alias("value")), symbols)
    pc = F.col("l_partkey") * 16 + _CODE_BASE + 4 * (F.col("l_linenumber") % 4)
    forms = {("A", "F"): "ldr c1, [c2]", ("A", "O"): "ldp x1, x2, [sp]", ("N", "F"): "stp czr, c2, [sp]", ("N", "O"): "str w1, [x2]", ("R", "F"): "scbnds c1, c1, #16"}
    code = F.lit("add x1, x1, #1")
    for (flag, status), form in forms.items():
        code = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), form).otherwise(code)
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    line = F.concat(F.lit("[0:"), text(F.col("l_orderkey")), F.lit("] 0x"), text(F.lower(F.hex(pc))), F.lit(": 0xd503201f "), text(code))
    # Three lines of the file in one row.
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", F.concat(line, F.lit("\n[0:1] something else\n-- cut --")).alias("value"))
    lines.write.partitionBy("l_linestatus").text(traces)
    return symbols, traces


def _instructions(spark, traces):
    return readers.parse_instructions(spark.read.schema("value string, l_linestatus string").text(traces))


_INSTRUCTIONS_SQL = f"""i AS (SELECT l_linestatus, l_partkey * 16 + {_CODE_BASE} + 4 * (l_linenumber % 4) AS pc, l_partkey, l_linenumber % 4 AS k,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'ld_cap' WHEN 'AO' THEN 'ld_pair_int' WHEN 'NF' THEN 'st_pair_cap' WHEN 'NO' THEN 'st_int' WHEN 'RF' THEN 'cheri' ELSE 'other' END AS class FROM lineitem),
    named AS (SELECT i.*, coalesce('fn_' || p_partkey, '0x' || lower(hex(pc))) AS symbol FROM i LEFT JOIN part ON p_partkey = l_partkey AND k < 1 + p_size % 4)"""


@query("instruction_histogram", f"WITH {_INSTRUCTIONS_SQL}, c AS (SELECT symbol, class, count(*) AS n FROM named GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY symbol)::BIGINT AS total FROM c")
def instruction_histogram(spark, sf_dir):
    """Instructions by symbol and class; addresses outside all symbols stand for themselves."""
    symbols, traces = _instruction_files(spark, sf_dir)
    return pipelines.instruction_histogram(spark, f"{traces}/*", readers.read_symbols(spark, symbols), kernel=False)[0]


@query("called_functions", f"WITH {_INSTRUCTIONS_SQL} SELECT 'fn_' || p_partkey AS name, count(*) AS calls FROM i JOIN part ON pc = p_partkey * 16 + {_CODE_BASE} GROUP BY 1")
def called_functions(spark, sf_dir):
    """Executions of the first instruction of each function."""
    symbols, traces = _instruction_files(spark, sf_dir)
    counts = pipelines.executed(readers.read_instructions(spark, f"{traces}/*"), [])
    return pipelines.executed_calls(counts, readers.read_symbols(spark, symbols))


@query("exact_symbols", f"WITH {_INSTRUCTIONS_SQL} SELECT pc::VARCHAR AS pc, 'fn_' || p_partkey AS name, n FROM (SELECT pc, count(*) AS n FROM i GROUP BY 1) JOIN part ON pc = p_partkey * 16 + {_CODE_BASE}")
def exact_symbols(spark, sf_dir):
    """Call targets that resolve to a symbol exactly; others are dropped."""
    symbols, traces = _instruction_files(spark, sf_dir)
    counts = readers.read_instructions(spark, f"{traces}/*").groupBy("pc").agg(F.count("*").alias("n"))
    found = intervals.nearest_lower(counts, readers.read_symbols(spark, symbols), "pc", "addr", ["name"], exact=True)
    return found.where("name is not null").select(F.col("pc").cast("string").alias("pc"), "name", "n")


@query(
    "instruction_difference",
    f"""WITH {_INSTRUCTIONS_SQL}, c AS (SELECT symbol, l_linestatus AS target, count(*) AS n FROM named GROUP BY ALL), t AS (SELECT DISTINCT target FROM c WHERE target IS DISTINCT FROM 'F'),
    s AS (SELECT symbol, target, n, 0 AS b FROM c WHERE target IS DISTINCT FROM 'F' UNION ALL SELECT c.symbol, t.target, 0, c.n FROM c CROSS JOIN t WHERE c.target = 'F') SELECT symbol, target, sum(n)::BIGINT AS n, sum(n - b)::BIGINT AS n_diff FROM s GROUP BY ALL""",
)
def instruction_difference(spark, sf_dir):
    """Instructions by symbol and target, against the baseline, also of symbols that only one of them runs; all targets are counted and named together."""
    symbols, traces = _instruction_files(spark, sf_dir)
    data = _instructions(spark, traces).withColumnRenamed("l_linestatus", "target")
    named = pipelines.with_symbol(pipelines.executed(data, ["target"]), readers.read_symbols(spark, symbols))
    each = stored(named.groupBy("symbol", "target").agg(F.sum("n").alias("n")), "functions")
    return trace.baseline_difference(each, ["symbol"], "target", "F", ["n"])


@query(
    "instructions_per_call",
    f"""WITH {_INSTRUCTIONS_SQL}, e AS (SELECT symbol, l_linestatus, class AS iteration, count(*) AS n, sum((k = 0)::INT)::BIGINT AS calls FROM named GROUP BY ALL), m AS (SELECT symbol, l_linestatus, median(n) AS n, median(calls) AS calls FROM e GROUP BY ALL),
    r AS (SELECT *, n / nullif(calls, 0) AS per FROM m) SELECT r.symbol, r.l_linestatus, r.n, r.calls, round(r.per, 6) AS insn_per_call, round(r.per - b.per, 6) AS delta_insn_per_call FROM r JOIN r b ON b.symbol = r.symbol AND b.l_linestatus = 'F' WHERE r.l_linestatus <> 'F'""",
)
def instructions_per_call(spark, sf_dir):
    """Medians over iterations of a function's instructions and calls, their ratio, and its change from the baseline run's."""
    symbols, traces = _instruction_files(spark, sf_dir)
    names = readers.read_symbols(spark, symbols)
    data = _instructions(spark, traces)
    counts = pipelines.executed(data, ["l_linestatus", trace.instruction_class(F.col("mnemonic"), F.col("operands")).alias("iteration")])
    found = pipelines.with_symbol(counts, names)
    # 2^63 is a multiple of 16.
    first = F.sum(F.when(F.col("address") % 16 == 0, F.col("n")).otherwise(0)).alias("call_count")
    each = stored(found.groupBy("symbol", "l_linestatus", "iteration").agg(F.sum("n").alias("instr_count"), first), "functions")
    out = pipelines.instructions_per_call(each, each, "F", "l_linestatus")
    return out.select("symbol", "l_linestatus", "n", "calls", *[F.round(c, 6).alias(c) for c in ("insn_per_call", "delta_insn_per_call")])


@query(
    "region_files",
    """
    WITH r AS (SELECT n_name AS name, n_nationkey::BIGINT * 4096 AS start, n_nationkey::BIGINT * 4096 + 6000 AS "end" FROM nation),
    a AS (SELECT l_partkey * 16 AS addr, 'fetch' AS kind, 4::BIGINT AS size FROM lineitem UNION ALL SELECT l_suppkey * 8, CASE WHEN l_returnflag = 'R' THEN 'read' ELSE 'write' END, l_quantity::BIGINT FROM lineitem)
    SELECT name, coalesce(sum((kind = 'fetch')::INT), 0)::BIGINT AS fetch_count, coalesce(sum(size) FILTER (kind = 'fetch'), 0)::BIGINT AS fetch_bytes, coalesce(sum((kind = 'read')::INT), 0)::BIGINT AS read_count, coalesce(sum(size) FILTER (kind = 'read'), 0)::BIGINT AS read_bytes, coalesce(sum((kind = 'write')::INT), 0)::BIGINT AS write_count, coalesce(sum(size) FILTER (kind = 'write'), 0)::BIGINT AS write_bytes
    FROM r LEFT JOIN a ON addr >= start AND addr < "end" GROUP BY 1
    """,
)
def region_files(spark, sf_dir):
    """Traffic of regions from a list with ends or lengths, in hexadecimal or decimals; written as a table and read back."""
    listing, out = fresh_path(spark, "regions"), fresh_path(spark, "traffic")
    start = F.col("n_nationkey").cast("long") * 4096
    end = F.when(F.col("n_nationkey") % 2 == 0, F.lit("+6000")).otherwise(F.concat(F.lit("0x"), F.hex(start + 6000)))
    good = F.concat_ws(", ", "n_name", F.concat(F.lit("0x"), F.lower(F.hex(start))), end)
    sinks.write_text(table(spark, sf_dir, "nation").select(F.explode(F.array(good, F.concat("n_name", F.lit(", oops")))).alias("value")), listing)
    access = F.struct((F.col("l_returnflag") == "R").alias("is_load"), (F.col("l_suppkey") * 8).alias("addr"), F.col("l_quantity").cast("long").alias("size"))
    records = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 16).alias("pc"), F.array(access).alias("mem"))
    sinks.write_regions(pipelines.region_memory(spark, listing, records), out)
    kinds = [f"{k}_{u}" for k in ("fetch", "read", "write") for u in ("count", "bytes")]
    return readers.read_csv(spark, out, "name string, " + ", ".join(f"{k} bigint" for k in kinds)).drop("file")


# -- layouts, bounds, advisories, caches ---------------------------------------------------------


@query("layout_store", f"WITH {MEMBERS_SQL} SELECT 'bin_' || o_orderpriority AS \"binary\", o_orderkey AS owner, name, byte_size::INT AS byte_size, array_items::BIGINT AS max_vla_size FROM members JOIN orders ON owner = o_orderkey WHERE is_pointer")
def layout_store(spark, sf_dir):
    """Chosen columns of a store of binaries, structures and members, some of them cast."""
    return readers.read_layouts(spark, _layout_store(spark, sf_dir), ["binary", "owner", "name", "byte_size", "max_vla_size"], {"byte_size": "int", "max_vla_size": "bigint"}, F.col("is_pointer"))


def _layout_store(spark, sf_dir):
    folder = fresh_path(spark, "layouts")
    orders = table(spark, sf_dir, "orders")
    orders.select(F.col("o_orderpriority").alias("id"), F.concat(F.lit("bin_"), "o_orderpriority").alias("file")).distinct().write.parquet(f"{folder}/binary.parquet")
    layout = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("kern/"), "o_orderstatus", F.lit(".h")).alias("file"), F.col("o_custkey").alias("line"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(0).alias("size"), F.col("o_orderpriority").alias("binary_id"), (F.col("o_orderstatus") != "P").alias("has_vla"))
    layout.write.parquet(f"{folder}/type_layout.parquet")
    members(spark, sf_dir).withColumn("max_vla_size", F.col("array_items").cast("string")).drop("l_shipdate").write.parquet(f"{folder}/layout_member.parquet")
    return folder


@query("vla_summary", f"WITH {MEMBERS_SQL} SELECT 'bin_' || o_orderpriority AS \"binary\", count(*) AS member_name FROM members JOIN orders ON owner = o_orderkey WHERE array_items IS NOT NULL AND o_orderstatus = 'O' GROUP BY 1")
def vla_summary(spark, sf_dir):
    """Arrays of variable length by binary, without those of ignored files."""
    columns = ["binary", F.col("name").alias("member_name"), F.col("src_file").alias("file"), "line", "byte_offset", "max_vla_size", "has_vla"]
    layout = readers.read_layouts(spark, _layout_store(spark, sf_dir)).select(*columns)
    return pipelines.vla_report(layout, ["binary"], [r"kern/F\.h"])[1]


@query(
    "imprecise_report",
    f"WITH {MEMBERS_SQL}, f AS (SELECT * FROM members WHERE is_imprecise) SELECT l_linestatus, count(*) AS members, count(DISTINCT owner) AS layouts, count(array_items) AS arrays, sum(is_pointer::INT)::BIGINT AS pointers, printf('%.2f%%', count(*) * 100.0 / sum(count(*)) OVER ()) AS share FROM f GROUP BY 1",
)
def imprecise_report(spark, sf_dir):
    """Summary of the imprecise members, of the structures that have one."""
    bounded = members(spark, sf_dir).withColumns({"base": F.col("byte_offset") - 3, "top": F.col("byte_offset") + F.col("byte_size") + 20})
    return pipelines.imprecise_report(stored(bounded, "members"), ["owner"], "l_linestatus")[1]


@query(
    "padding_distribution",
    f"WITH {MEMBERS_SQL}, e AS (SELECT 2.0 ** k::INT AS low, 2.0 ** (k + 1)::INT AS high, k AS bin FROM range(0, 6) t(k)), p AS (SELECT l_linestatus, byte_size FROM members WHERE is_imprecise) SELECT l_linestatus, low, high, count(*) AS count FROM p JOIN e ON byte_size >= low AND (byte_size < high OR (bin = 5 AND byte_size = high)) GROUP BY ALL",
)
def padding_distribution(spark, sf_dir):
    """Sizes of imprecise members between powers of two."""
    out = pipelines.size_distribution(members(spark, sf_dir).where("is_imprecise"), ["l_linestatus"], "byte_size")
    return out.where("count > 0").select("l_linestatus", "low", "high", "count")


@query("layout_listing", f"WITH {MEMBERS_SQL} SELECT owner, replace(name, owner::VARCHAR || '::', '') AS short_name, (length(name) - length(replace(name, '::', ''))) // 2 AS depth, array_items IS NOT NULL AS is_array, 'l_linestatus=' || l_linestatus AS block FROM members")
def layout_listing(spark, sf_dir):
    """Short names, depth, array flag and block label of members."""
    own = members(spark, sf_dir).withColumn("owner_name", F.col("owner").cast("string"))
    view = layouts.layout_view(own, "owner_name", "name", "array_items", ["l_linestatus"], ["owner_name", "byte_offset"])
    return view.select("owner", "short_name", F.col("depth").cast("long").alias("depth"), "is_array", "block")


_STRUCTS_SQL = f"{MEMBERS_SQL}, t AS (SELECT owner, l_linestatus, sum(byte_size)::BIGINT AS size, coalesce(sum(array_items), 0) + coalesce(sum(number), 0) / 8.0 AS padding FROM members GROUP BY ALL)"


def _structs(spark, sf_dir):
    return pipelines.struct_report(stored(members(spark, sf_dir), "members"), ["owner"], "l_linestatus", "F", padding="array_items", padding_bits="number", pointer="is_pointer", size="byte_size")


@query("struct_sizes", f"WITH {_STRUCTS_SQL}, q AS (SELECT l_linestatus, avg(size) AS mean, median(size) AS median, stddev_samp(size) AS std, quantile_cont(size, 0.25) AS q25, quantile_cont(size, 0.75) AS q75 FROM t GROUP BY 1) SELECT q.l_linestatus, round(q.mean, 5) AS mean, round(q.std, 5) AS std, q.q25, q.q75, round(q.median - b.median, 5) AS median_delta, round((q.mean - b.mean) / b.mean, 6) AS mean_norm FROM q, q b WHERE b.l_linestatus = 'F'")
def struct_sizes(spark, sf_dir):
    """Statistics of structure sizes of each target against the baseline's."""
    out = _structs(spark, sf_dir)[1]
    return out.select("l_linestatus", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "q25", "q75", F.round("median_delta", 5).alias("median_delta"), F.round("mean_norm", 6).alias("mean_norm"))


@query("struct_growth", f"WITH {_STRUCTS_SQL}, b AS (SELECT owner, ceil(size / 64)::BIGINT AS base_lines FROM t WHERE l_linestatus = 'F') SELECT owner, l_linestatus, ceil(size / 64)::BIGINT AS lines, base_lines, ceil(size / 64) > base_lines AS grows, ceil(size / 64) > base_lines AND ceil((size - padding) / 64) <= base_lines AS fixable FROM t JOIN b USING (owner) WHERE l_linestatus <> 'F'")
def struct_growth(spark, sf_dir):
    """Structures that take more cache lines than the baseline's."""
    return _structs(spark, sf_dir)[2]


def _bounds(spark, sf_dir):
    folder = fresh_path(spark, "bounds")
    where = F.when(F.col("p_size") % 3 == 0, "<unknown>").otherwise(F.concat("p_name", F.lit(".c")))
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("module"), F.lit("4").alias("alignment_bits"), (F.col("p_size") * F.col("p_partkey")).cast("string").alias("size"), F.col("p_brand").alias("kind"), where.alias("source_loc"), F.lit("pass").alias("compiler_pass"), F.lit("d").alias("details"))
    # Listings are written twice: kernel and modules repeat each other.
    sinks.write_csv(rows.union(rows), folder, by=["module"])
    return f"{folder}/*"


_BOUNDS_SQL = "b AS (SELECT DISTINCT p_size * p_partkey AS size, p_brand AS kind, CASE WHEN p_size % 3 <> 0 THEN p_name || '.c' END AS source_loc FROM part)"


@query("large_bounds", f"WITH {_BOUNDS_SQL} SELECT size, kind, source_loc FROM b WHERE size > 4096")
def large_bounds(spark, sf_dir):
    """Distinct bounds over a size; sources of unknown origin are null."""
    return pipelines.bounds_distribution(spark, _bounds(spark, sf_dir))[1].select("size", "kind", "source_loc")


@query("bounds_distribution", f"WITH {_BOUNDS_SQL}, e AS (SELECT 2.0 ** k::INT AS low, 2.0 ** (k + 1)::INT AS high FROM range(0, 40) t(k)) SELECT kind, CASE WHEN size = 0 THEN 0.0 ELSE low END AS low, count(*) AS count FROM b LEFT JOIN e ON size >= low AND size < high WHERE size > 0 GROUP BY ALL")
def bounds_distribution(spark, sf_dir):
    """Sizes of bounds between powers of two, by kind."""
    out = pipelines.bounds_distribution(spark, _bounds(spark, sf_dir))[0].where("count > 0 and low > 0")
    # The last bin holds its upper edge too, which is a power of two of its own in the SQL.
    return out.select("kind", "low", "count")


_ADVISORIES_SQL = "a AS (SELECT year(o_orderdate) AS year, o_orderstatus <> 'P' AS safety, o_orderpriority = '1-URGENT' AS uaf, o_orderpriority = '2-HIGH' AS race, CASE WHEN o_custkey % 5 = 0 THEN 'subobject' WHEN o_custkey % 5 < 3 THEN 'ptr_bounds' WHEN o_custkey % 5 = 3 THEN 'unmitigated' ELSE 'other' END AS mitigation FROM orders)"


def _advisories(spark, sf_dir):
    folder = fresh_path(spark, "advisories")
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    part = F.col("o_custkey") % 5
    # A flag that is false is left out.
    flag = lambda c: F.when(c, True)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("SA-"), F.col("o_orderkey").cast("string")).alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), flag(F.col("o_orderstatus") != "P").alias("kind_memory_safety"), flag(urgent).alias("kind_uaf"), flag(high).alias("kind_race"), flag(part < 3).alias("mitigation_ptr_bounds"), flag(part == 0).alias("mitigation_subobject"), flag(part == 3).alias("mitigation_unmitigated"))
    sinks.write_json(rows, folder)
    return pipelines.advisory_history(readers.read_advisories(spark, folder, lines=True))


@query("advisory_years", f"WITH {_ADVISORIES_SQL}, c AS (SELECT year, count(*) AS total, sum(safety::INT) AS m, sum((safety AND NOT uaf AND NOT race)::INT) AS s FROM a GROUP BY 1) SELECT year, total, unnest(['memory_safety', 'spatial_safety']) AS category, unnest([m, s])::BIGINT AS n, round(unnest([m, s]) * 100 / total, 2) AS percent FROM c")
def advisory_years(spark, sf_dir):
    """Advisories of each year, and the shares of those of memory safety and of its spatial part."""
    return _advisories(spark, sf_dir)[0]


@query("advisory_mitigations", f"WITH {_ADVISORIES_SQL}, c AS (SELECT mitigation, count(*) AS n, CASE mitigation WHEN 'ptr_bounds' THEN 1 WHEN 'subobject' THEN 2 WHEN 'other' THEN 3 ELSE 4 END AS k FROM a WHERE safety GROUP BY 1) SELECT mitigation, n, round(sum(n) OVER (ORDER BY k) / sum(n) OVER (), 6) AS share FROM c")
def advisory_mitigations(spark, sf_dir):
    """Running share of advisories by what mitigates them."""
    return _advisories(spark, sf_dir)[1].withColumn("share", F.round("share", 6))


@query("cache_miss_table", "SELECT p_size * 1024::BIGINT AS size, p_size || 'K' AS size_text, round(count(*) / 100.0, 2) AS miss_rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_size")
def cache_miss_table(spark, sf_dir):
    """Miss rates below a section of reports, by the cache size in a report's name."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy("p_size").agg(F.count("*").alias("n"))
    folder = fresh_path(spark, "caches")
    text = text_of("L1I:\n  miss rate: 99.0%%\nL1D:\n  hits: 4\n  miss rate: %s%%\n  miss rate: 1%%", F.round(F.col("n") / 100, 2))
    rows.select(F.concat(F.col("p_size").cast("string"), F.lit("K")).alias("size"), text.alias("value")).write.partitionBy("size").text(folder)
    return pipelines.cache_miss_table(spark, f"{folder}/*", "L1D:", name="/size=([0-9]+[KMG])/")


# -- tracks --------------------------------------------------------------------------------------


def _track_store(spark, sf_dir):
    """Events as slices with arguments, counters of tracks type:slot, and intervals of contexts."""
    folder = fresh_path(spark, "tracks")
    events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type", "value", "props")
    events.select(F.col("event_id").alias("arg_set_id"), "ts", F.col("event_type").alias("name")).write.parquet(f"{folder}/slice.parquet")
    events.select(F.col("event_id").alias("arg_set_id"), F.explode(F.array(F.struct(F.lit("user").alias("key"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("props").alias("key"), F.col("props").alias("value")))).alias("a")).select("arg_set_id", "a.*").write.parquet(f"{folder}/args.parquet")
    slot = F.when(F.col("user_id") % 2 == 0, 0).otherwise(3)
    track = F.concat_ws(":", "event_type", slot.cast("string"))
    events.select(track.alias("track_id"), "ts", "value").write.parquet(f"{folder}/counter.parquet")
    events.select(track.alias("track_id"), track.alias("name")).distinct().write.parquet(f"{folder}/counter_track.parquet")
    hour = F.hour(F.timestamp_micros("ts"))
    events.select(F.col("user_id").alias("track_id"), "ts", hour.alias("start"), (hour + 5).alias("end"), F.floor("value").cast("long").alias("value")).write.parquet(f"{folder}/interval.parquet")
    users = events.select("user_id").distinct()
    users.select(F.col("user_id").alias("track_id"), (F.col("user_id") % 7).alias("upid"), F.col("user_id").alias("utid"), (F.col("user_id") % 3).alias("ucid")).write.parquet(f"{folder}/context_track.parquet")
    users.select((F.col("user_id") % 7).alias("upid")).distinct().select("upid", (F.col("upid") + 100).alias("pid")).write.parquet(f"{folder}/process.parquet")
    users.select(F.col("user_id").alias("utid"), (F.col("user_id") + 1000).alias("tid")).write.parquet(f"{folder}/thread.parquet")
    users.select((F.col("user_id") % 3).alias("ucid")).distinct().select("ucid", F.col("ucid").alias("cid"), F.lit(0).alias("el")).write.parquet(f"{folder}/compartment.parquet")
    users.agg(F.lit(readers.PACKET_LOSS).alias("name"), F.lit(0).alias("value")).write.parquet(f"{folder}/stats.parquet")
    return folder


_SINCE, _UNTIL = 1_704_500_000_000_000, 1_706_000_000_000_000


@query("track_slices", f"SELECT epoch_us(ts) AS ts, event_type AS name, user_id::VARCHAR AS \"user\", props FROM events WHERE epoch_us(ts) >= {_SINCE} AND epoch_us(ts) < {_UNTIL}")
def track_slices(spark, sf_dir):
    """Slices of a time range with their arguments."""
    found = readers.read_track(spark, _track_store(spark, sf_dir), "slice", _SINCE, _UNTIL)
    return found.select("ts", "name", F.col("args")["user"].alias("user"), F.col("args")["props"].alias("props"))


@query(
    "counter_tracks",
    f"""WITH e AS (SELECT event_type AS name, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 3 END AS slot, epoch_us(ts) AS us, value FROM events WHERE epoch_us(ts) >= {_SINCE})
    SELECT name || CASE slot WHEN 0 THEN ' items' ELSE ' cpu 2' END AS counter_name, us - {_SINCE} AS ts, round(CASE WHEN slot = 0 THEN value - first_value(value) OVER (PARTITION BY name, slot ORDER BY us) + 1 ELSE value END, 6) AS value FROM e""",
)
def counter_tracks(spark, sf_dir):
    """Counters of known zones under their display names; those that only rise begin at 1."""
    folder = _track_store(spark, sf_dir)
    if readers.lost_packets(spark, folder):
        raise ValueError("the trace has lost packets")
    values = readers.read_counter_slots(spark, folder, _SINCE).withColumn("iteration", F.lit(0))
    zones = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    out = pipelines.counter_tracks(values, zones, {0: "items", 1: "cpu {cpu}"}, [0], per_cpu={1: 9})
    return out.select("counter_name", "ts", F.round("value", 6).alias("value"))


@query(
    "context_intervals",
    f"SELECT 100 + user_id % 7 AS pid, user_id + 1000 AS tid, user_id % 3 AS cid, hour(ts)::INT AS start, (hour(ts) + 5)::INT AS \"end\", sum(floor(value)::BIGINT)::BIGINT AS value FROM events WHERE epoch_us(ts) < {_UNTIL} GROUP BY ALL HAVING sum(floor(value)::BIGINT) <> 0",
)
def context_intervals(spark, sf_dir):
    """Values of equal intervals of each process, thread and compartment, added up."""
    rows = readers.read_contexts(spark, _track_store(spark, sf_dir), until=_UNTIL)
    return intervals.sum_equal_intervals(rows, ["pid", "tid", "cid"], "start", "end", "value")


@query(
    "function_trace",
    """
    WITH m AS (SELECT user_id, ts FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'login')), e AS (SELECT ev.user_id, ev.event_type, m.ts AS start, floor(ev.value)::BIGINT AS n FROM events ev ASOF LEFT JOIN m ON m.user_id = ev.user_id AND ev.ts >= m.ts),
    k AS (SELECT * FROM e WHERE start IS NOT NULL OR user_id NOT IN (SELECT user_id FROM m)), s AS (SELECT user_id, start, length(event_type) AS pc, sum(n) AS v FROM k GROUP BY ALL),
    f AS (SELECT user_id, start, CASE WHEN pc >= 8 THEN 'long' WHEN pc >= 5 THEN 'short' ELSE 'unknown' END AS name, sum(v) AS v FROM s GROUP BY ALL)
    SELECT name, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v)::BIGINT AS low, max(v)::BIGINT AS high, count(*) AS iterations FROM f GROUP BY 1
    """,
)
def function_trace(spark, sf_dir):
    """Statistics per function over the iterations that markers cut."""
    events = table(spark, sf_dir, "events")
    calls = events.select("user_id", "ts", F.length("event_type").cast("long").alias("pc"), F.lit("app").alias("space"), F.floor("value").cast("long").alias("n"))
    markers = events.where("event_type = 'login'").select("user_id", "ts").distinct()
    symbols = events.groupBy(F.lit("shared").alias("space")).agg(F.lit(1).alias("_n")).select("space", F.explode(F.array(F.struct(F.lit(5).cast("long").alias("addr"), F.lit("short").alias("name")), F.struct(F.lit(8).cast("long").alias("addr"), F.lit("long").alias("name")))).alias("s")).select("space", "s.*")
    out = pipelines.function_trace(calls, markers, symbols, ["user_id"])
    return out.select("name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "low", "high", "iterations")


# -- tables --------------------------------------------------------------------------------------


@query(
    "annotated_trace",
    """
    WITH s AS (SELECT user_id, event_id, CASE WHEN event_type IN ('login', 'view', 'click') THEN 1 ELSE -1 END AS step, event_type, row_number() OVER w AS seq FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY seq) - CASE WHEN step > 0 THEN 1 ELSE 0 END AS depth FROM s)
    SELECT repeat('  ', greatest(depth, 0)::INT) || '0x' || lower(hex(event_id)) || ' ' || CASE WHEN step > 0 THEN 'ENTER' ELSE 'LEAVE' END || ' libx.so:' || event_type AS value, count(*) AS n FROM d GROUP BY 1
    """,
)
def annotated_trace(spark, sf_dir):
    """Readable lines of a trace, indented by depth, written compressed and read back."""
    op = F.when(F.col("event_type").isin("login", "view", "click"), "enter").otherwise("leave")
    records = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", op.alias("op"), F.col("event_id").alias("address"), F.lit("/usr/lib/libx.so").alias("compartment"), F.col("event_type").alias("symbol"), F.lit("/bin/app").alias("caller"))
    lines, _ = pipelines.annotated_trace(records, ["user_id"], ["ts", "event_id"])
    folder = fresh_path(spark, "annotated")
    sinks.write_text(lines, folder, compress=True)
    return spark.read.text(folder).groupBy("value").agg(F.count("*").alias("n"))


@query("tables_by_value", "SELECT l_linestatus, l_returnflag, l_linenumber AS iteration, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL")
def tables_by_value(spark, sf_dir):
    """One table for each value of an axis, as CSV with a header, read as one again."""
    folder = fresh_path(spark, "tables")
    sinks.write_csv(sums(spark, sf_dir).select(*FLAGS, "iteration", "q"), folder, by=["l_linestatus"])
    found = readers.read_csv(spark, f"{folder}/*", "l_returnflag string, iteration int, q bigint")
    return found.select(F.regexp_extract("file", "/l_linestatus=([A-Z])/", 1).alias("l_linestatus"), "l_returnflag", "iteration", "q")


@query("json_tables", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, n, q FROM s")
def json_tables(spark, sf_dir):
    folder = fresh_path(spark, "json")
    sinks.write_json(sums(spark, sf_dir).select(*FLAGS, "iteration", "n", "q"), folder)
    return readers.read_json(spark, folder, "l_returnflag string, l_linestatus string, iteration int, n bigint, q bigint", lines=True).drop("file")


@query("runs_of_paths", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, q AS value FROM s")
def runs_of_paths(spark, sf_dir):
    """Tables of many runs, keyed by the ids and iterations in their paths."""
    rows = sums(spark, sf_dir)
    path = fresh_path(spark, "runs")
    sinks.write_csv(rows.select(F.col("dataset_id").alias("dataset"), "iteration", F.col("q").alias("value")), path, by=["dataset", "iteration"])
    data = readers.read_runs(spark, f"{path}/*/*/*.csv", "value bigint", runs_of(rows, FLAGS), r"/iteration=([0-9]+)", r"/dataset=([0-9a-f-]{36})/")
    return data.select(*FLAGS, "iteration", "value")


@query("selected_runs", f"WITH {SUMS_SQL} SELECT l_returnflag, l_linestatus, iteration, q AS value FROM s WHERE l_linestatus = 'F'")
def selected_runs(spark, sf_dir):
    """Of a store of runs the folders of those that a rule selects."""
    rows = sums(spark, sf_dir)
    sinks.write_run_store(rows.select("dataset_id", "iteration", F.col("q").alias("value")), path := fresh_path(spark, "store"))
    return readers.read_run_store(spark, path, "value bigint", runs_of(rows, FLAGS).where("l_linestatus = 'F'")).select(*FLAGS, "iteration", "value")


@query(
    "sliced_overhead",
    f"WITH {SUMS_SQL}, d AS (SELECT l_returnflag, l_linestatus, iteration, q AS value FROM s WHERE l_returnflag <> 'R' AND NOT (l_returnflag = 'A' AND l_linestatus = 'O' AND iteration = 7)), long AS ({overhead_sql('d', ['l_returnflag'], {'l_returnflag': 'N'}, ['l_linestatus'])}) SELECT * FROM long",
)
def sliced_overhead(spark, sf_dir):
    """One job for all slices of a fixed axis, after rules that keep and drop runs."""
    rows = sums(spark, sf_dir).withColumnRenamed("q", "value")
    out = pipelines.sliced(
        rows, ["l_linestatus"], lambda df, **options: compare.median_overhead(df, "value", {"l_returnflag": "N"}, **options), ["l_returnflag"],
        keep=[{"l_returnflag": "N"}, {"l_returnflag": "A"}], drop=[{"l_returnflag": "A", "l_linestatus": "O", "iteration": 7}],
    )
    return point(out, "value")


@query(
    "labelled_bars",
    """
    WITH d AS (SELECT o_orderpriority AS x, o_orderstatus AS g, count(*) AS n, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2),
    xi AS (SELECT x, row_number() OVER (ORDER BY min(ord)) - 1 AS x_index FROM d GROUP BY 1), r AS (SELECT *, floor(log10(n))::INT AS p FROM d)
    SELECT x, g, n, x_index, (round(n / 10.0 ** (p - 2)) * 10.0 ** (p - 2))::BIGINT::VARCHAR AS label_text, n AS label_at FROM r JOIN xi USING (x)
    """,
)
def labelled_bars(spark, sf_dir):
    """Bars with their values in three significant digits."""
    data = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("g")).agg((F.count("*")).alias("n"), F.min("o_orderkey").alias("ord"))
    out = pipelines.bar_table(data, "x", "n", "ord", shift_by="g")
    return out.select("x", "g", "n", "x_index", F.regexp_replace("label_text", r"\.0+$", "").alias("label_text"), "label_at")


@query("plot_rows", f"WITH {SUMS_SQL} SELECT l_returnflag || '/' || l_linestatus AS flavor, iteration, round(q / n, 6) AS per_line, q::VARCHAR || 'B' AS size_text FROM s WHERE l_linestatus = 'F'")
def plot_rows(spark, sf_dir):
    """The table behind a grid of plots: columns by reference, derived, filtered, in order."""
    rows = sums(spark, sf_dir)
    names = shape.References({"flag": "l_returnflag", "status": "l_linestatus"})
    joined = shape.derive(rows, "flavor", ["<flag>", "<status>"], "concat", names, separator="/")
    typed = shape.lower_columns(joined.withColumnRenamed("q", "Q"))
    numbers = shape.columns_like(typed, types=["bigint"], pattern="^[nq]$")
    out = coords.plot_table(typed, F.col("l_linestatus") == "F", {"per_line": F.round(F.col(numbers[1]) / F.col(numbers[0]), 6), "size_text": F.concat(F.col("q").cast("string"), F.lit("B"))}, ["flavor", "iteration"])
    return out.select("flavor", "iteration", "per_line", "size_text")


@query("conforming_rows", "SELECT o_orderkey, o_orderpriority, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS level FROM orders WHERE o_orderstatus IN ('F', 'O')")
def conforming_rows(spark, sf_dir):
    """Columns of a schema, cast; rows with a value outside an allowed list are left out."""
    from pyspark.sql import types as T

    from runledger.checks import conform

    schema = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderpriority", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("o_orderstatus", T.StringType())])
    rows = table(spark, sf_dir, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1))
    return conform(rows, schema, {"o_orderstatus": ["F", "O"]}).drop("o_orderstatus")


@query(
    "counted_violations",
    """
    WITH r AS (SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || o_orderkey % 5 AS level, o_orderstatus FROM orders)
    SELECT unnest(['rows', 'level_type', 'priority_type', 'priority_null', 'o_orderstatus_type', 'o_orderstatus_value', 'written']) AS rule,
        unnest([count(*), count_if(try_cast(level AS INT) IS NULL), 0, count_if(priority IS NULL), 0, count_if(o_orderstatus NOT IN ('F', 'O')), count_if(priority IS NOT NULL AND o_orderstatus IN ('F', 'O'))]) AS broken FROM r
    """,
)
def counted_violations(spark, sf_dir):
    """Rows that break each rule of a schema, counted while those that break none are written."""
    from pyspark.sql import types as T

    from runledger.session import fresh_path
    from runledger.sources.sinks import write_conforming

    schema = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("priority", T.StringType(), False), T.StructField("o_orderstatus", T.StringType())])
    level = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""), (F.col("o_orderkey") % 5).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("priority"), level.alias("level"), "o_orderstatus")
    counts = write_conforming(rows, schema, path := fresh_path(spark, "conforming"), {"o_orderstatus": ["F", "O"]})
    told = spark.createDataFrame(sorted(counts.items()), "rule string, broken long")
    return told.union(spark.read.parquet(path).select(F.lit("written").alias("rule"), F.lit(1).alias("one")).groupBy("rule").agg(F.count("*").alias("broken")))


@query("custom_order", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END")
def custom_order(spark, sf_dir):
    """All groups in the order of a list."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return shape.custom_order(counts, {"o_orderpriority": ["5-LOW", "3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]})


@query("filled_values", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM events")
def filled_values(spark, sf_dir):
    """The value of a user's last purchase beside every event."""
    events = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return align.forward_filled(events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "value")


@query("baseline_of_one_row", f"WITH {SUMS_SQL}, b AS (SELECT q FROM s WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND iteration = 1) SELECT l_returnflag, l_linestatus, iteration, s.q - b.q AS delta FROM s, b")
def baseline_of_one_row(spark, sf_dir):
    """A baseline without degrees of freedom stands beside every row."""
    from runledger.operators.compare import align_baseline

    out = align_baseline(sums(spark, sf_dir), "q", BASELINE_ROW, ["l_returnflag", "l_linestatus", "iteration"])
    return out.select(*FLAGS, "iteration", (F.col("q") - F.col("_baseline")).alias("delta"))


BASELINE_ROW = {"l_returnflag": "N", "l_linestatus": "F", "iteration": 1}


@query("baseline_by_name", f"WITH {SUMS_SQL} SELECT l_linestatus, iteration, q FROM s WHERE l_returnflag = 'R'")
def baseline_by_name(spark, sf_dir):
    """The slice of a baseline that is given by the name of an instance."""
    from runledger.keys import baseline_slice

    rows = sums(spark, sf_dir).withColumn("dataset_gid", run_id("l_returnflag"))
    runs = rows.select("dataset_gid", F.concat(F.lit("instance-"), "l_returnflag").alias("instance_name")).distinct()
    return baseline_slice(rows, {"instance": "instance-R"}, runs).select("l_linestatus", "iteration", "q")


@query("range_precision", "WITH p AS (SELECT o_orderkey, o_custkey * 8 AS base, o_custkey * 8 + o_orderkey % 1000 + 1 AS top FROM orders) SELECT o_orderkey, (floor(log2(top - base)) - least(CASE WHEN base = 0 THEN 63 ELSE log2(base & -base) END, log2(top & -top)) + 1)::INT AS bits, CASE WHEN floor(log2(top - base)) + 1 <= 12 THEN 12 ELSE 10 END AS platform FROM p")
def range_precision(spark, sf_dir):
    """Bits that address ranges need, and those that a format has for them."""
    from runledger.functions.scalars import platform_precision, required_precision

    base = F.col("o_custkey") * 8
    top = base + F.col("o_orderkey") % 1000 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", required_precision(base, top).alias("bits"), platform_precision(base, top, 14).alias("platform"))


@query("frame_names", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size % 8 = 0 THEN '' WHEN p_size % 4 = 0 THEN '??`' || p_name WHEN p_size % 4 = 1 THEN 'kernel`' || p_name ELSE lower(p_type) || '`' || p_name END AS frame FROM part")
def frame_names(spark, sf_dir):
    """Names of symbols in folded stacks."""
    file = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 1, "/boot/kernel.full").otherwise(F.concat(F.lit("/lib/"), F.lower("p_type"), F.lit(".so")))
    return table(spark, sf_dir, "part").select("p_partkey", trace.frame_name(F.col("p_name"), file, F.when(F.col("p_size") % 8 == 0, -1).otherwise(F.col("p_partkey"))).alias("frame"))


@query("inconsistent_keys", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def inconsistent_keys(spark, sf_dir):
    """Keys that should have one value and have several."""
    from runledger.checks import consistent

    return consistent(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@query(
    "parameter_matrix",
    """
    WITH m AS (SELECT r_name AS region, s AS status, i AS iteration FROM region, (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT DISTINCT l_linenumber AS i FROM lineitem) WHERE NOT (r_name = 'ASIA' AND s = 'P') AND i <> 7)
    SELECT region, status, line_number, CASE WHEN status = 'F' AND region = 'EUROPE' THEN 'old' WHEN status = 'F' THEN 'done' ELSE 'open' END AS host, sha256(region || chr(31) || status || chr(31) || line_number) AS dataset_id FROM (SELECT *, iteration AS line_number FROM m)
    """,
)
def parameter_matrix(spark, sf_dir):
    """All runs of the axes that tables span, without skipped ones, on hosts by the first rule that matches."""
    from runledger.keys import parameter_matrix as matrix

    values = lambda name, c: [r[0] for r in table(spark, sf_dir, name).select(c).distinct().orderBy(c).collect()]
    axes = {"region": values("region", "r_name"), "status": values("orders", "o_orderstatus"), "line_number": values("lineitem", "l_linenumber")}
    hosts = [({"status": "F", "region": "EUROPE"}, "old"), ({"status": "F"}, "done"), ({}, "open")]
    return matrix(spark, axes, [{"region": "ASIA", "status": "P"}, {"line_number": 7}], {"host": hosts})
