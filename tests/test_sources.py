import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from runledger.sources import readers, sinks, splits
from runledger.streaming import transitions


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_timings(spark, tmp_path):
    put(tmp_path, "t1", "real 1.23\nuser 0.5\nsys 0.1\n")
    assert rows(readers.read_posix_time(spark, str(tmp_path / "t1")), "times", "user", "sys") == [(1.23, 0.5, 0.1)]
    good = put(tmp_path, "h.json", {"results": [{"times": [2.0], "exit_codes": [0], "user": 1.0, "system": 0.5}]})
    assert rows(readers.read_hyperfine(spark, good), "times", "user", "sys") == [(2.0, 1.0, 0.5)]
    for bad in ({"times": [1, 2], "exit_codes": [0, 0]}, {"times": [1], "exit_codes": [1]}):
        path = put(tmp_path, "b.json", {"results": [bad | {"user": 1.0, "system": 0.5}]})
        with pytest.raises(Exception, match="not one successful time"):
            readers.read_hyperfine(spark, path).collect()


def test_tables_and_runs(spark, tmp_path):
    run = "0123456789abcdef-0123-0123456789abcde"[:36]
    for k in (0, 1):
        put(tmp_path, f"{run}/iteration-{k}/x.csv", f"a,b\n{k},q\n")
    runs = spark.createDataFrame([(run, "base")], "dataset_id string, target string")
    got = readers.read_runs(spark, str(tmp_path / "*" / "*" / "x.csv"), "a int, b string", runs)
    assert rows(got, "a", "b", "iteration", "target") == [(0, "q", 0, "base"), (1, "q", 1, "base")]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.yaml", "a int")


def test_network(spark, tmp_path):
    sums = {"seconds": 10.0, "bytes": 100, "bits_per_second": 80.0}
    path = put(tmp_path, "i.json", {"start": {"sndbuf_actual": 1, "rcvbuf_actual": 2, "test_start": {"blksize": 3}}, "end": {"sum_sent": sums, "sum_received": sums | {"bytes": 90}}})
    assert rows(readers.read_iperf(spark, path), "side", "bytes", "blksize") == [("receiver", 90, 3), ("sender", 100, 3)]
    udp = put(tmp_path, "u.json", {"start": {}, "end": {"sum_sent": sums, "sum_received": sums, "sum": {"jitter_ms": 0.5, "packets": 7, "lost_packets": 1, "lost_percent": 14.0}}})
    assert rows(readers.read_iperf(spark, udp, udp=True), "jitter_ms", "packets") == [(0.5, 7), (0.5, 7)]
    with pytest.raises(Exception, match="iperf"):
        readers.read_iperf(spark, put(tmp_path, "e.json", {"error": "refused"})).collect()
    qps = put(tmp_path, "q.json", {"summary": {"qps": 5.0, "messageCount": 9, "latency90": 1.5}, "scenario": {"clientConfig": {"payloadConfig": {"simpleParams": {"reqSize": 4}}}}})
    assert rows(readers.read_qps(spark, qps), "qps", "message_count", "latency90", "req_size", "resp_size") == [(5.0, 9.0, 1.5, 4, 0)]
    redis = put(tmp_path, "r.csv", "requests_per_second,latency_ms,errors,connections\n10,1,0,5\n20,2,3,5\n")
    assert rows(readers.read_redis(spark, redis), "requests_per_second", "has_errors") == [(10.0, True), (20.0, True)]
    wrk = put(tmp_path, "w.json", {"scenario": "s_128b", "summary": {"duration": 2_000_000, "requests": 10, "bytes": 5}, "errors": {"read": 1, "status": 2}, "latency": {"min": 1, "percentile50": 2.5, "percentile95": 3, "percentile999": 4}})
    assert rows(readers.read_wrk(spark, wrk), "request_size", "errors", "requests_per_second", "latency_percentile50", "latency_percentile95", "latency_percentile999") == [(128, 2, 5.0, 2.5, 3.0, 4.0)]
    with pytest.raises(Exception, match="no request size"):
        readers.read_wrk(spark, put(tmp_path, "bad.json", {"scenario": "plain", "summary": {"duration": 1}})).collect()
    perf = put(tmp_path, "n.csv", "MIGRATED TCP\nThroughput,Elapsed Time,Units\n12.5,10,Mb\n")
    assert rows(readers.read_netperf(spark, perf, ["Throughput", "Elapsed Time", "Missing"]), "throughput", "elapsed time", "missing") == [(12.5, 10.0, None)]
    # No line of a long file is left out.
    long = put(tmp_path, "long.csv", "MIGRATED TCP\nThroughput\n" + "1\n" * ((1 << 20) + 5))
    assert readers.read_netperf(spark, long, ["Throughput"]).count() == (1 << 20) + 5


def test_counters_and_stacks(spark, tmp_path):
    path = put(tmp_path, "pmc-2.txt", "# p/CPU_CYCLES p/INST_RETIRED\n 10 1\n 20 2\n")
    assert rows(readers.read_counters_series(spark, path), "cpu", "name", "value", "iteration") == [(None, "cpu_cycles", 30.0, 1), (None, "inst_retired", 3.0, 1)]
    system = put(tmp_path, "sys.txt", "# s/00/CPU_CYCLES s/01/CPU_CYCLES\n1 2\n3 4\n")
    assert rows(readers.read_counters(spark, system), "cpu", "name", "value") == [(0, "cpu_cycles", 4.0), (1, "cpu_cycles", 6.0)]
    graph = put(tmp_path, "g.txt", "@ CPU_CYCLES [100 samples]\n\n60.0% [60] main @ /bin/a\n  50.0% [30] f @ /bin/a\n    50.0% [15] h @ /bin/a\n  25.0% [15] g @ /bin/a\n40.0% [40] idle @ kernel\n")
    stacks = readers.read_callgraph(spark, graph)
    assert rows(stacks, "stack", "samples", "total") == [("g;main", 15, 100), ("h;f;main", 15, 100), ("idle", 40, 100)]
    for bad in ("no header\n", "@ CPU [1 samples]\n50% main\n"):
        with pytest.raises(Exception, match="not a"):
            readers.read_callgraph(spark, put(tmp_path, "bad.txt", bad)).collect()
    sinks.write_folded(stacks, str(tmp_path / "folded"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "folded")).collect()) == ["g;main 15", "h;f;main 15", "idle 40"]


def test_lines(spark, tmp_path):
    ctl = put(tmp_path, "ctl", "kern.a=1\nkern.b=x = y\nnothing\n")
    assert rows(readers.read_sysctl(spark, ctl), "sysctl_name", "sysctl_value") == [("kern.a", "1"), ("kern.b", "x = y")]
    trace = "12 ktrace RTLD: c18n: libc -> libm at [3] sqrt\nnoise\n12 ktrace RTLD: c18n: libm -> libc at [4] malloc\n"
    path = put(tmp_path, "live/t.txt", trace)
    assert rows(readers.read_transitions(spark, path), "pid", "caller", "callee", "symbol_number", "symbol") == [(12, "libc", "libm", 3, "sqrt"), (12, "libm", "libc", 4, "malloc")]
    q = transitions.stream_transitions(spark, str(tmp_path / "live")).writeStream.format("memory").queryName("live").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("live"), "caller", "callee", "n") == [("libc", "libm", 1), ("libm", "libc", 1)]
    finally:
        q.stop()
    code = put(tmp_path, "ins", "[0:1] 0xffffffc000001000: 0xd503201f  nop\nbad\n[0:2] 0x1004: 0xf9400000  ldr x0, [x1]\n")
    got = readers.read_instructions(spark, code)
    assert sorted((int(a), b, c) for a, b, c in rows(got, "pc", "mnemonic", "operands")) == [(0x1004, "ldr", "x0, [x1]"), (0xFFFFFFC000001000, "nop", "")]
    syms = put(tmp_path, "syms", "main T 1000 20\ndata D 2000 8\nshort T\n")
    assert [(n, k, int(a), int(z)) for n, k, a, z in rows(readers.read_symbols(spark, syms, base=1), "name", "kind", "addr", "size")] == [("data", "OBJECT", 0x2001, 8), ("main", "FUNC", 0x1001, 32)]
    regions = put(tmp_path, "reg", "heap, 0x100, 0x200\nstack, 512, +16\nbad line\nneg, 5, 1\n")
    assert [(n, int(a), int(z)) for n, a, z in rows(readers.read_regions(spark, regions), "name", "start", "end")] == [("heap", 256, 512), ("stack", 512, 528)]
    maps = put(tmp_path, "map", "PID START END PRT RES PRES REF SHD FLAG TP PATH\n7 0x10000 0x20000 r-x 1 1 1 1 C vn /bin/sh\n7 0x30000 0x40000 rw- 1 1 1 1 C vn /bin/sh\n7 0x50000 0x60000 rw- 1 1 1 1 C df\n")
    assert [(p, n, int(a)) for p, n, a in rows(readers.mapped_binaries(readers.read_process_map(spark, maps)), "pid", "path", "start")] == [(7, "/bin/sh", 0x10000)]


def test_code(spark, tmp_path):
    count = put(tmp_path, "c.json", {"header": {"x": 1}, "a.c": {"code": 3}, "b.h": {"code": 4}, "SUM": {"code": 7}})
    assert rows(readers.read_cloc(spark, count), "name", "code") == [("a.c", 3), ("b.h", 4)]
    diff = put(tmp_path, "d.json", {"added": {"a.c": {"code": 2}}, "modified": {}, "removed": {"b.c": {"code": 1}}, "same": {"a.c": {"code": 9}}})
    assert rows(readers.read_cloc_diff(spark, diff), "name", "added", "removed", "same") == [("a.c", 2, 0, 9), ("b.c", 0, 1, 0)]
    db = put(tmp_path, "db.csv", "file_name\n./a/../b.c\nb.c\n")
    assert rows(readers.read_compilation_db(spark, db), "name") == [("b.c",)]
    strace = put(tmp_path, "s.txt", 'openat(AT_FDCWD, "/src/sys/a.c", O_RDONLY) = 3\nopenat(AT_FDCWD, "/other/b.c"\nopenat(AT_FDCWD, "/src/x.txt"\nopenat(1, "/src/./sys/a.c"\n')
    assert rows(readers.read_strace_files(spark, strace, "/src"), "name") == [("sys/a.c",)]
    notes = put(tmp_path, "ann.json", '{"file":"./k/a.c","updates":["20210101"],"changes":null}\n{"file":"b.c","changes":["x"],"hybrid_specific":true}\n')
    assert rows(readers.read_annotations(spark, notes), "name", "changes", "hybrid_specific") == [("b.c", ["x"], True), ("k/a.c", [], False)]
    put(tmp_path, "tree/x/a.c", "__subobject y;\nint z;\n__subobject w;\n")
    assert [(p, n) for p, n in rows(readers.scan_sources(spark, str(tmp_path / "tree"), {"mark": "__subobject", "never": "zzz"}), "pattern", "n")] == [("mark", 2)]
    put(tmp_path, "mods/if_x/b.csv", "alignment_bits,size,kind,source_loc,compiler_pass,details\n4,16,s,<unknown location>,p,d\nx,8,h,a.c:1,p,d\n")
    assert rows(readers.read_bounds(spark, str(tmp_path / "mods" / "*" / "b.csv")), "alignment_bits", "size", "source_loc", "src_module") == [(4, 16, None, "if_x"), (None, 8, "a.c:1", "if_x")]
    put(tmp_path, "cache-64K.txt", "Core #0\nL1I stats:\n miss rate: 1.00%\nL1D stats:\n miss rate: 2.50%\n")
    put(tmp_path, "cache-1M.txt", "L1D stats:\n miss rate: 0.50%\n")
    got = readers.read_cache_reports(spark, str(tmp_path / "cache-*.txt"), "L1D stats").collect()
    assert [(r["size"], r["miss_rate"]) for r in got] == [(65536, 2.5), (1 << 20, 0.5)]


def test_snapshots(spark, tmp_path):
    malloc = lambda n, z: {"malloc-statistics": {"memory": [{"type": "mbuf", "in-use": n, "memory-use": 10 * n, "requests": n, "size": z}]}}
    a, b = (readers.read_malloc(spark, put(tmp_path, f"m{k}.json", malloc(k, z))) for k, z in ((1, [16]), (5, [16, 32])))
    assert rows(readers.malloc_delta(a, b), "type", "in_use", "memory_use", "new_sizes") == [("mbuf", 4, 40, [32])]
    zone = lambda n: {"memory-zone-statistics": {"zone": [{"name": "UMA 16", "size": 16, "limit": 0, "used": n, "free": 1, "requests": n, "fail": 0}]}}
    a, b = (readers.read_zones(spark, put(tmp_path, f"z{k}.json", zone(k))) for k in (1, 3))
    delta = readers.zone_delta(a, b)
    assert rows(delta, "name", "used", "size") == [("UMA 16", 2, 16)]
    nodes = spark.createDataFrame([("vm.uma.UMA_16.bucket_size", "128"), ("vm.uma.UMA_16.keg.ppera", "1"), ("vm.uma.other.x", "5")], "node string, value string")
    assert rows(readers.zone_info(delta, nodes), "bucket_size", "ppera", "ipers") == [(128, 1, 0)]
    work = lambda n: {"netisr": {"workstream": [{"work": [{"workstream": 0, "cpu": 1, "name": "ip", "length": 0, "watermark": 1, "dispatched": n, "queued": 0, "handled": n}]}]}}
    a, b = (readers.read_netisr(spark, put(tmp_path, f"n{k}.json", work(k))) for k in (2, 9))
    assert rows(readers.netisr_delta(a, b), "name", "dispatched", "handled") == [("ip", 7, 7)]
    pids = put(tmp_path, "p.json", {"create": [{"pid": 3, "name": "init"}], "thr-create": [{"pid": 3, "tid": 30, "name": "main"}, {"pid": 4, "tid": 40, "name": "x"}]})
    assert rows(readers.read_pid_map(spark, pids), "pid", "tid", "process", "thread") == [(3, 30, "init", "main")]


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "store")
    spark.createDataFrame([(1, "a.so")], "id long, file string").write.parquet(f"{folder}/binary.parquet")
    spark.createDataFrame([(5, "a.h", 6, "foo", 32, 1)], "id long, file string, line int, name string, size long, binary_id long").write.parquet(f"{folder}/type_layout.parquet")
    spark.createDataFrame([(5, "x", 0), (9, "lost", 0)], "owner long, name string, byte_offset long").write.parquet(f"{folder}/layout_member.parquet")
    assert rows(readers.read_layouts(spark, folder), "binary", "struct", "name") == [("a.so", "foo", "x")]
    spark.createDataFrame([(10, 1), (20, None)], "ts long, arg_set_id long").write.parquet(f"{folder}/slice.parquet")
    spark.createDataFrame([(1, "k", "v")], "arg_set_id long, key string, value string").write.parquet(f"{folder}/args.parquet")
    assert rows(readers.read_track(spark, folder, "slice", until=20), "ts", "args") == [(10, {"k": "v"})]
    spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0), (2, 5, 9.0)], "track_id long, ts long, value double").write.parquet(f"{folder}/counter.parquet")
    spark.createDataFrame([(1, "insn"), (2, "other")], "track_id long, name string").write.parquet(f"{folder}/counter_track.parquet")
    assert rows(readers.read_track(spark, folder, "insn", since=6), "value") == [(3.0,)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "scenario string, v int")
    sinks.write_csv(frame, str(tmp_path / "by"), by=["scenario"])
    assert spark.read.option("header", True).csv(str(tmp_path / "by" / "scenario=a")).collect()[0]["v"] == "1"
    sinks.write_json(frame, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_text(frame.select(F.col("scenario").alias("value")), str(tmp_path / "txt"), compress=True)
    assert list((tmp_path / "txt").glob("*.gz"))


def _graph(rng, lines):
    """A call graph, and its stacks by a plain walk."""
    text, open_, want, depth = ["@ CPU_CYCLES [900 samples]"], [], {}, 0
    depths = [0]
    for _ in range(lines - 1):
        depths.append(rng.choice([d for d in (depths[-1] + 2, depths[-1], depths[-1] - 2, 0) if d >= 0]))
    for k, depth in enumerate(depths):
        name, samples = f"f{rng.randrange(6)}", rng.randrange(50)
        open_ = [*open_[: depth // 2], name]
        text.append(f"{' ' * depth}1.0% [{samples}] {name} @ /bin/a")
        if k + 1 == len(depths) or depths[k + 1] <= depth:
            stack = ";".join(reversed(open_))
            want[stack] = want.get(stack, 0) + samples
        if rng.random() < 0.05:
            text.append("")
    return "\n".join(text) + "\n", want


def test_call_graphs_of_several_splits(spark, tmp_path):
    rng = random.Random(5)
    want = {}
    for name, lines in (("large", 3000), ("small", 3), ("one", 1), ("other", 700)):
        text, want[name] = _graph(rng, lines)
        put(tmp_path, f"graphs/{name}.txt", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    try:
        # One file is read by many tasks.
        assert splits.placed_lines(spark, str(tmp_path / "graphs/large.txt")).select("block").distinct().count() > 5
        got = readers.read_callgraph(spark, str(tmp_path / "graphs/*.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in got:
        assert (r["counter"], r["total"]) == ("CPU_CYCLES", 900)
        found.setdefault(r["file"].split("/")[-1].removesuffix(".txt"), {})[r["stack"]] = r["samples"]
    assert found == want


def test_headers_of_several_splits(spark, tmp_path):
    rows_ = [(k, k % 7) for k in range(2000)]
    path = put(tmp_path, "n.csv", "BANNER\nElapsed,Throughput\n" + "".join(f"{a},{b}\n" for a, b in rows_) + "\nlast\n")
    cache = put(tmp_path, "c-64K.txt", "miss rate: 9%\n" + "x\n" * 3000 + "L1D stats: miss rate: 3.5% miss rate: 7%\n" + "y\n" * 3000 + "miss rate: 8%\n")
    plain = put(tmp_path, "c-1M.txt", "miss rate: 9%\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    try:
        got = rows(readers.read_netperf(spark, path, ["Throughput", "Elapsed"]), "elapsed", "throughput")
        rates = readers.read_cache_reports(spark, [cache, plain], "L1D stats").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r for r in got if r[0] is not None) == sorted((float(a), float(b)) for a, b in rows_) and len(got) == 2001
    assert [(r["size_text"], r["miss_rate"]) for r in rates] == [("64K", 3.5), ("1M", None)]


def test_a_selection_of_runs_reads_only_its_folders(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    data = spark.range(60).select((F.col("id") % 6).cast("string").alias("dataset_id"), (F.col("id") % 2).cast("int").alias("iteration"), F.col("id").alias("v"))
    sinks.write_run_store(data, root)
    runs = spark.createDataFrame([(str(k), "a" if k < 2 else "b") for k in range(6)], "dataset_id string, axis string")
    for listed in (10_000, 1):
        monkeypatch.setattr(readers, "LISTED_RUNS", listed)
        chosen = runs.where("axis = 'a'") if listed > 1 else spark.read.parquet(_written(runs, f"file://{tmp_path}/runs")).where("axis = 'a'")
        got = readers.read_run_store(spark, root, "v bigint", chosen)
        assert sorted(r["v"] for r in got.collect()) == [k for k in range(60) if k % 6 < 2]
        plan = got._jdf.queryExecution().executedPlan().toString()
        filters = next(line for line in plan.splitlines() if "PartitionFilters" in line and "dataset_id" in line)
        assert "dataset_id" in filters and (" IN (" in plan or "dynamicpruning" in plan)


def _written(df, path):
    df.write.parquet(path)
    return path


def test_written_folders_of_a_run_are_removed(spark, tmp_path):
    from runledger import session

    session.remove_written(spark)
    kept = session.stored(spark.range(3), "own")
    session.fresh_path(spark, "never-written")
    kept.write.parquet(f"file://{tmp_path}/result")
    files = kept.inputFiles()
    assert files and pathlib.Path(files[0].removeprefix("file://")).exists()
    assert session.remove_written(spark) == 1 and session.remove_written(spark) == 0
    assert not pathlib.Path(files[0].removeprefix("file://")).exists()
    assert spark.read.parquet(f"file://{tmp_path}/result").count() == 3
