import json

import pytest
from pyspark.sql import functions as F

from runledger.operators.shape import Component
from runledger.plans import pipelines
from runledger.sources import readers

IDS = ("aaaaaaaa-0000-0000-0000-000000000001", "aaaaaaaa-0000-0000-0000-000000000002")
BASE = {"target": "base"}


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(list(zip(IDS, ("base", "other"))), "dataset_id string, target string")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of two runs with three iterations; the second run takes twice as long."""
    root = tmp_path_factory.mktemp("runs")
    for r, run in enumerate(IDS):
        for k in range(3):
            at = root / run / f"iteration-{k}"
            at.mkdir(parents=True)
            n = (r + 1) * (10 + k)
            (at / "time.txt").write_text(f"real {n}\nuser 1\nsys 1\n")
            sums = {"seconds": 1, "bytes": n, "bits_per_second": n * 1e6}
            (at / "iperf.json").write_text(json.dumps({"start": {}, "end": {"sum_sent": sums, "sum_received": sums}}))
            (at / "qps.json").write_text(json.dumps({"summary": {"qps": n, "latency90": 1000 * n, "messageCount": 2}}))
            (at / "redis.csv").write_text(f"requests_per_second,latency_ms,errors,connections\n{n},1,0,1\n")
            (at / "pmc.txt").write_text(f"# s/0/CPU_CYCLES s/1/CPU_CYCLES s/0/INST_RETIRED\n{n} {n} 4\n")
            (at / "net.csv").write_text(f"BANNER\nThroughput,Latency\n{n},5\n")
            (at / "wrk.json").write_text(json.dumps({"scenario": "x_64b", "summary": {"duration": 1_000_000, "requests": n, "bytes": 1}, "latency": {}}))
            (at / "before.ctl").write_text("a=1\nb=2\n")
            (at / "after.ctl").write_text(f"a={n}\n" + ("b=5\n" if r else ""))
            (at / "rtld.txt").write_text("1 x RTLD: c18n: p -> q at [1] f\n1 x RTLD: c18n: p -> p at [1] g\n" * n)
    return str(root / "*" / "*")


def values(df, metric, kind):
    return {r["target"]: r[metric] for r in df.collect() if r["_metric_type"] == kind}


def test_comparisons(spark, runs, folder):
    times = pipelines.timing_comparison(spark, f"{folder}/time.txt", runs, BASE, ["target"])
    assert values(times, "times", "absolute") == {"base": 11.0, "other": 22.0} and values(times, "times", "overhead") == {"other": 1.0}
    rates = pipelines.throughput_summary(spark, f"{folder}/iperf.json", runs, BASE, ["target"])
    assert values(rates, "bits_per_second", "delta") == {"other": 11.0}
    rpc = pipelines.rpc_summary(spark, f"{folder}/qps.json", runs, BASE, ["target"], "latency90")
    assert values(rpc, "latency90", "absolute")["other"] == 22.0
    store = pipelines.store_summary(spark, f"{folder}/redis.csv", runs, BASE, ["target"], inverted=True)
    assert values(store, "requests_per_second", "overhead") == {"other": -1.0}
    net = pipelines.network_metrics(spark, f"{folder}/net.csv", runs, ["Throughput", "Latency"], BASE, ["target"])
    assert {(r["target"], r["metric"], r["value"]) for r in net.collect() if r["_metric_type"] == "overhead"} >= {("other", "throughput", 1.0), ("other", "latency", 0.0)}
    pmc = pipelines.counter_summary(spark, f"{folder}/pmc.txt", runs, BASE, ["target"])
    assert {(r["target"], r["name"], round(r["value"], 3)) for r in pmc.collect()} >= {("base", "cpu_cycles", 22.0), ("other", "cycles_per_insn", 11.0)}
    below, bands = pipelines.http_load(spark, f"{folder}/wrk.json", runs, BASE, ["target"])
    assert [(r["target"], r["overhead"]) for r in below.collect()] == [("other", -100.0)] and bands.count() == 2


def test_samples_and_transitions(spark, runs, folder):
    got = pipelines.before_after_samples(spark, f"{folder}/before.ctl", f"{folder}/after.ctl", runs)
    assert got.count() == 12 and got.where("sysctl_name = 'b' and value is null").count() == 3
    pairs, own = pipelines.transition_frequency(spark, f"{folder}/rtld.txt", runs, ["target"])
    assert pairs.count() == 12 and {(r["target"], r["iteration"], r["total"], r["rate"]) for r in own.collect()} >= {("base", 0, 20, 0.5), ("other", 2, 48, 0.5)}


def test_code_tables(spark, tmp_path):
    lines = spark.createDataFrame([("base", "sys/a.c", 10), ("base", "lib/b.c", 90), ("new", "sys/a.c", 5), ("new", "skip/z.c", 9)], "target string, name string, code int")
    known = spark.createDataFrame([("sys/a.c",), ("lib/b.c",), ("lib/lost.c",)], "name string")
    table, missing = pipelines.code_churn(lines, [Component("kernel", pattern="^sys/")], BASE, ["target"], known, reject=["skip/"])
    assert {(r["target"], r["component"]): r["code_pct"] for r in table.collect()} == {("base", "kernel"): 100, ("base", "other"): 100, ("new", "kernel"): 50}
    assert [r["name"] for r in missing.collect()] == ["lib/lost.c"]
    notes = spark.createDataFrame([("sys/a.c", ["x", "y"], ["y"]), ("gone.c", ["x"], [])], "name string, changes array<string>, changes_purecap array<string>")
    tags = {r["tag"]: (r["files"], r["of_changed"], round(r["of_all"], 2)) for r in pipelines.annotation_tags(notes, known).collect()}
    assert tags == {"x": (1, 100, 33.33), "y": (1, 100, 33.33)}
    counts = spark.createDataFrame([("m", "/src/sys/a.c", 2), ("m", "/src/lib/b.c", 3), ("w", "/src/sys/c.c", 5)], "pattern string, file string, n long")
    got = {r["component"]: (r["m"], r["w"]) for r in pipelines.annotation_table(counts, {"kernel": "/sys/"}, ["m", "w"]).collect()}
    assert got == {"kernel": (2, 5), "other": (3, 0), "Total": (5, 5)}


def test_instruction_histogram(spark, tmp_path):
    (tmp_path / "t").write_text("".join(f"[0:{k}] 0x{pc:x}: 0x1 {m} x0\n" for k, (pc, m) in enumerate([(0x1000, "ldr"), (0x1004, "add"), (0x1000, "ldr"), (0x2000, "add"), (0x9000, "str")])))
    (tmp_path / "s").write_text("f T 1000 10\ng T 2000 4\n")
    symbols = readers.read_symbols(spark, str(tmp_path / "s"))
    per, calls = pipelines.instruction_histogram(spark, str(tmp_path / "t"), symbols, kernel=False)
    assert {(r["symbol"], r["class"], r["n"], r["total"]) for r in per.collect()} == {("f", "ld_int", 2, 3), ("f", "other", 1, 3), ("g", "other", 1, 1), ("0x9000", "st_int", 1, 1)}
    assert {r["name"]: r["calls"] for r in calls.collect()} == {"f": 2, "g": 1}
    diff = pipelines.instruction_difference({"a": per, "b": per.withColumn("n", F.col("n") * 2)}, "a")
    assert {r["symbol"]: r["n_diff"] for r in diff.collect()} == {"f": 3, "g": 1, "0x9000": 1}


def test_allocator_and_trace(spark):
    before = spark.createDataFrame([(t, z, 16, 0, 0, 0, 0) for t in ("base", "new") for z in "abc"], "target string, name string, size long, used long, free long, requests long, fail long")
    after = spark.createDataFrame([("base", "a", 16, 1, 0, 0, 0), ("base", "b", 16, 5, 0, 0, 0), ("base", "c", 16, 0, 0, 0, 0), ("new", "a", 16, 9, 0, 0, 0), ("new", "b", 16, 5, 0, 0, 0), ("new", "c", 16, 0, 0, 0, 0)], before.schema)
    top = pipelines.allocator_table(before, after, BASE, ["target"]).where("target = 'new'").collect()
    assert [(r["name"], r["median_delta"]) for r in top] == [("a", 8.0)]
    calls = spark.createDataFrame([(1, 5, 100, "p", 2), (1, 15, 104, "p", 3), (1, 25, 50, "p", 1)], "run int, ts long, pc long, space string, n long")
    markers = spark.createDataFrame([(1, 0), (1, 10), (1, 20)], "run int, ts long")
    symbols = spark.createDataFrame([("p", 90, "f"), ("shared", 10, "lib")], "space string, addr long, name string")
    got = {r["name"]: (r["mean"], r["iterations"]) for r in pipelines.function_trace(calls, markers, symbols, ["run"]).collect()}
    assert got == {"f": (2.5, 2), "lib": (1.0, 1)}


def test_members(spark):
    members = spark.createDataFrame([("s", "a", 0, 8, 0, 12, True, 1, False, "x"), ("s", "b", 8, 8, None, None, False, None, True, "x"), ("t", "c", 0, 8, None, None, False, None, False, "x")], "owner string, name string, byte_offset long, byte_size long, base long, top long, is_imprecise boolean, array_items int, is_pointer boolean, kind string")
    annotated, summary = pipelines.imprecise_report(members, ["owner"], "kind")
    assert {r["name"]: r["_aliased_by"] for r in annotated.collect()} == {"a": [], "b": [0]}
    assert [(r["members"], r["arrays"], r["share"]) for r in summary.collect()] == [(1, 1, "100.00%")]
    assert sum(r["count"] for r in pipelines.size_distribution(members, [], "byte_size").collect()) == 3


def test_counters_of_unknown_zones_are_left_out(spark):
    values = spark.createDataFrame([(0, "a", 0, 5, 7.0), (0, "a", 0, 9, 9.0), (0, "a", 3, 5, 4.0), (0, "b", 0, 5, 1.0), (0, None, 0, 5, 1.0), (1, "a", 0, 2, 3.0)], "iteration int, name string, slot int, ts long, value double")
    zones = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "name string")
    got = pipelines.counter_tracks(values, zones, {0: "items", 1: "cpu {cpu}"}, [0], per_cpu={1: 9}).collect()
    assert sorted((r["iteration"], r["counter_name"], r["ts"], r["value"]) for r in got) == [(0, "a cpu 2", 5, 4.0), (0, "a items", 5, 1.0), (0, "a items", 9, 3.0), (1, "a items", 2, 1.0)]
