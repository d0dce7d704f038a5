"""Queries that take every row of their tables, against plain Python."""

import math
from collections import Counter

from runledger import keys
from runledger.operators import trace
from runledger.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_range_join_takes_all_lines(spark):
    bands = [(low := math.floor(r["p_retailprice"] * 100), low + 40 * r["p_size"]) for r in rows(spark, "part")]
    points = Counter((r["l_partkey"], math.floor(r["l_extendedprice"] / r["l_quantity"] * 100)) for r in rows(spark, "lineitem"))
    want: dict[int, list[int]] = {}
    for (part, at), n in points.items():
        hits = sum(low <= at < high for low, high in bands)
        if hits:
            found = want.setdefault(part, [0, 0])
            found[0] += hits
            found[1] += hits * n
    got = {r["l_partkey"]: [r["bands"], r["n"]] for r in registry.QUERIES["range_join_bands"](spark, SF).collect()}
    assert got == want


def test_merged_sessions_take_all_orders(spark):
    orders = rows(spark, "orders")
    runs = Counter((r["o_orderstatus"], r["o_orderpriority"]) for r in orders)
    last = {k: max(r["o_orderkey"] for r in orders if (r["o_orderstatus"], r["o_orderpriority"]) == k) for k in runs}
    got = {(r["o_orderstatus"], r["o_orderpriority"]): (r["source_id"], r["destination_id"]) for r in registry.QUERIES["session_merge"](spark, SF).collect()}
    assert got == {(s, p): (f"s{n}", f"d{s}{p}NATION_3") for (s, p), n in last.items()}
    counted = {(r["o_orderstatus"], r["o_orderpriority"]): r["runs"] for r in registry.QUERIES["session_merge_duplicates"](spark, SF).collect()}
    assert counted == {k: n for k, n in runs.items() if n > 1}


def test_last_runs_by_partial_maxima(spark):
    source = spark.createDataFrame([("s1", "a", None), ("s2", "a", 2), ("s3", "b", None), ("s4", "c", 1), ("s5", "c", 1)], "dataset_id string, k string, ord int")
    destination = spark.createDataFrame([("d1", "a"), ("d2", "b"), ("d3", "c"), ("d4", "e")], "dataset_id string, k string")
    merged = keys.merge_by_key(source, destination, ["k"], order="ord").matched
    assert {r["destination_id"]: r["source_id"] for r in merged.collect()} == {"d1": "s2", "d2": "s3", "d3": "s5"}
    assert "Window" not in merged._jdf.queryExecution().executedPlan().toString()


def test_thread_names_of_all_and_of_missing_partners(spark):
    names = {r["c_custkey"]: r["c_name"] for r in rows(spark, "customer")}
    want = sorted((r["o_custkey"], r["o_orderkey"], names.get(r["o_custkey"], f"undetected:{r['o_custkey']}"), r["o_orderpriority"]) for r in rows(spark, "orders"))
    got = registry.QUERIES["thread_names"](spark, SF).select("pid", "tid", "process", "thread").collect()
    assert sorted(map(tuple, got)) == want
    frame = lambda given, columns: spark.createDataFrame(given, columns)
    out = trace.thread_names(frame([(1, "p")], "pid long, name string"), frame([(1, 5, "t")], "pid long, tid long, name string"), frame([(1, 5), (1, 6), (2, 5)], "pid long, tid long"))
    assert {tuple(r) for r in out.select("pid", "tid", "process", "thread").collect()} == {(1, 5, "p", "t"), (1, 6, "p", "unknown:6"), (2, 5, "undetected:2", "unknown:5")}


def test_differences_of_symbols_that_one_side_lacks(spark):
    size = {r["p_partkey"]: 1 + r["p_size"] % 4 for r in rows(spark, "part")}
    name = lambda part, k: f"fn_{part}" if k < size.get(part, 0) else f"0x{part * 16 + 0x40000 + 4 * k:x}"
    runs = Counter((name(r["l_partkey"], r["l_linenumber"] % 4), r["l_linestatus"]) for r in rows(spark, "lineitem"))
    want = {s: (runs[s, "O"], runs[s, "O"] - runs[s, "F"]) for s, _ in runs}
    got = registry.QUERIES["instruction_difference"](spark, SF).collect()
    assert any(n == 0 for n, _ in want.values()) and len(got) == len(want)
    assert {r["symbol"]: (r["n"], r["n_diff"]) for r in got} == want and {r["target"] for r in got} == {"O"}
    counts = [("f", "a", 5), ("f", "b", 7), ("g", "a", 2), ("h", "c", 4), (None, "a", 1), (None, "c", 3), ("f", None, 6)]
    df = spark.createDataFrame(counts, "k string, t string, n long")
    full = {("f", "b", 7, 2), ("f", "c", 0, -5), ("f", None, 6, 1), ("h", "c", 4, 4), (None, "b", 0, -1), (None, "c", 3, 2), (None, None, 0, -1)}
    full |= {("g", t, 0, -2) for t in ("b", "c", None)}
    out = [tuple(r) for r in trace.baseline_difference(df, ["k"], "t", "a", ["n"]).collect()]
    assert set(out) == full and len(out) == len(full)
    own = trace.baseline_difference(df, ["k"], "t", "a", ["n"], lacking=False).collect()
    assert {tuple(r) for r in own} == {("f", "b", 7, 2), ("h", "c", 4, 4), (None, "c", 3, 3)}
