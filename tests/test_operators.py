import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runledger import checks, keys
from runledger.functions import scalars
from runledger.operators import align, coords, histogram, intervals, layouts, ordered, quantiles, shape, trace


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_sizes_and_numbers(spark):
    for n, text in ((0, "0"), (512, "512"), (1024, "1KiB"), (1536, "1.5KiB"), (3 << 30, "3GiB")):
        assert one(spark, scalars.bytes_to_text(F.lit(n))) == text
    for text, n in (("4k", 4096), ("4KiB", 4096), ("2 MB", 2 << 20), ("17", 17), ("1.5G", 3 << 29)):
        assert one(spark, scalars.text_to_bytes(F.lit(text))) == n
    with pytest.raises(Exception, match="not a size"):
        one(spark, scalars.text_to_bytes(F.lit("4 parsecs")))
    assert int(one(spark, scalars.hex_to_decimal(F.lit("0xffffffffffffffff")))) == 2**64 - 1
    assert one(spark, scalars.decimal_to_hex(F.lit("18446744073709551615"))) == "0xffffffffffffffff"
    for x, text in ((10.0, "10"), (0.0, "0"), (1234.5, "1230"), (0.012345, "0.0123"), (float("nan"), ""), (-2.5, "-2.5")):
        assert one(spark, scalars.significant(F.lit(x))) == text


def test_paths(spark):
    for path, want in (("a//b/./c", "a/b/c"), ("/x/../y", "/y"), ("a/../../b", "../b"), ("./", "."), ("/a/b/../../../c", "/c")):
        assert one(spark, scalars.normal_path(F.lit(path))) == want
    assert one(spark, scalars.basename(F.lit("/a/b.tar.gz"))) == "b.tar.gz"
    assert one(spark, scalars.stem(F.lit("/a/b.tar.gz"))) == "b.tar"
    assert scalars.snake_case("messageCount") == "message_count" and scalars.snake_case("latency999") == "latency999"


def test_range_joins_agree(spark):
    rng = random.Random(2)
    points = [(k, rng.randrange(0, 500), rng.choice("ab")) for k in range(300)]
    ranges = [(k, (a := rng.randrange(0, 480)), a + rng.choice([0, 1, 5, 90, 4000]), rng.choice("ab")) for k in range(80)]
    p = spark.createDataFrame(points, "id int, pos int, space string")
    r = spark.createDataFrame(ranges, "rid int, low int, high int, space string")
    want = sorted((i, j) for i, x, s in points for j, a, z, t in ranges if s == t and a <= x < z)
    for bucket in (None, 1, 7, 1000):
        got = intervals.range_join(p, r, "pos", "low", "high", bucket=bucket, keys=["space"])
        assert sorted((g["id"], g["rid"]) for g in got.collect()) == want
        left = intervals.range_join(p, r, "pos", "low", "high", how="left", bucket=bucket, keys=["space"]).collect()
        assert len(left) == len(want) + len({i for i, *_ in points} - {i for i, _ in want})


def test_range_join_of_any_numbers(spark):
    rng = random.Random(12)
    inf = float("inf")
    cases = {
        "double": ([rng.uniform(-3, 3) * 10 ** rng.randrange(-6, 9) for _ in range(200)] + [inf, -inf, float("nan"), None, 0.0], [-inf, -1e300, -5.0, -1e-7, 0.0, 1e-9, 0.5, 2e6, 1e300, inf, None]),
        "decimal(20,0)": ([Decimal(2**64 - rng.randrange(1, 5000)) for _ in range(100)] + [Decimal(rng.randrange(10**6)) for _ in range(100)] + [None], [Decimal(x) for x in (0, 7, 900_000, 2**63, 2**64 - 4000, 2**64 - 3999, 2**64 - 1)]),
        "long": ([rng.choice([-1, 1]) * 2 ** rng.randrange(62) + rng.randrange(3) for _ in range(200)] + [2**63 - 1, -(2**63), None], [-(2**63), -(2**40), -5, 0, 1, 2, 2**30, 2**62, 2**63 - 1, None]),
    }
    for kind, (points, bounds) in cases.items():
        ranges = [(k, a, z) for k, (a, z) in enumerate((a, z) for a in bounds for z in bounds)]
        p = spark.createDataFrame(list(enumerate(points)), f"id int, pos {kind}")
        r = spark.createDataFrame(ranges, f"rid int, low {kind}, high {kind}")
        want = sorted((i, j) for i, x in enumerate(points) for j, a, z in ranges if None not in (x, a, z) and a <= x < z)
        assert sorted((g["id"], g["rid"]) for g in intervals.range_join(p, r, "pos", "low", "high").collect()) == want
        left = intervals.range_join(p, r, "pos", "low", "high", how="left").collect()
        assert sorted((g["id"], g["rid"]) for g in left if g["rid"] is not None) == want
        assert sorted(g["id"] for g in left if g["rid"] is None) == sorted(set(range(len(points))) - {i for i, _ in want})
        assert intervals.range_join(p, r.limit(0), "pos", "low", "high", how="left").count() == len(points)
        assert intervals.range_join(p.limit(0), r, "pos", "low", "high").collect() == []


def test_one_wide_range_leaves_narrow_ones_alone(spark):
    points = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("pos"))
    narrow = spark.range(60_000).select(F.col("id").alias("rid"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)).alias("low")).withColumn("high", F.col("low") + 10)
    wide = narrow.unionByName(spark.sql("select -1L as rid, -5L as low, 1000000000000L as high"))
    level, dealt, pieces = intervals._levels(wide, "low", "high", "whole", None)
    # A level for each width, and no range in more buckets than two.
    assert sorted(set(dealt.values())) == [2, 20] and pieces == 2 * 60_001
    took, rows = [], []
    for ranges in (narrow, narrow, wide):
        began = time.perf_counter()
        rows.append(intervals.range_join(points, ranges, "pos", "low", "high").count())
        took.append(time.perf_counter() - began)
    assert rows[2] == rows[1] + 200_000
    assert took[2] < 2 * took[1] + 1
    # A few wider ones are cut into buckets of the level below instead.
    mixed = narrow.unionByName(spark.range(10).select((-F.col("id")).alias("rid"), F.lit(0).cast("long").alias("low"), F.lit(600).cast("long").alias("high")))
    assert set(intervals._levels(mixed, "low", "high", "whole", None)[1].values()) == {2}


def test_nearest_lower(spark):
    p = spark.createDataFrame([(1, 5), (2, 10), (3, 99), (4, 1)], "id int, pos int")
    s = spark.createDataFrame([(5, "f"), (50, "g"), (50, "h")], "addr int, name string")
    got = {r["id"]: r["name"] for r in intervals.nearest_lower(p, s, "pos", "addr", ["name"]).collect()}
    assert got == {1: "f", 2: "f", 3: "h", 4: None}
    exact = {r["id"]: r["name"] for r in intervals.nearest_lower(p, s, "pos", "addr", ["name"], exact=True).collect()}
    assert exact == {1: "f", 2: None, 3: None, 4: None}


def test_merge_matches_containment(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), (a := rng.randrange(30)), a + rng.randrange(0, 9), rng.randrange(5)) for _ in range(80)]
    frame = spark.createDataFrame(rows, "k string, s int, e int, v int")
    want = {}
    for k in "xy":
        edges = sorted({x for r in rows if r[0] == k and r[2] > r[1] for x in r[1:3]})
        for a, z in zip(edges, edges[1:]):
            inside = [r[3] for r in rows if r[0] == k and r[2] > r[1] and r[1] <= a and r[2] >= z]
            if inside:
                want[k, a, z] = (sum(inside), len(inside))
    got = {(r["k"], r["start"], r["end"]): (r["value"], r["covers"]) for r in intervals.merge_intervals(frame, ["k"], "s", "e", "v").collect()}
    assert got == want


def test_histogram_counts_all_rows(spark):
    frame = spark.range(0, 101).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    rows = histogram.histogram(frame, ["g"], "x", [0, 10, 50, 100]).collect()
    assert len(rows) == 9 and sum(r["count"] for r in rows) == 101
    assert histogram.power_of_two_edges(1, 9) == [1, 2, 4, 8, 16]
    assert histogram.power_of_two_edges(-3, 3) == [-4, -2, -1, 0, 1, 2, 4]
    right = histogram.histogram(frame.where("x <= 10"), [], "x", [0, 5, 10], closed="right").collect()
    assert [r["count"] for r in sorted(right, key=lambda r: r["bin"])] == [6, 5]


def test_coordinates(spark):
    frame = spark.createDataFrame([(k, c, 1) for k, c in enumerate("BABCA")], "o int, c string, v int")
    got = [r["i"] for r in coords.first_appearance(frame, "c", "o", "i").orderBy("o").collect()]
    assert got == [0, 1, 0, 2, 1]
    both = [(k, a, g, s, v) for k, (a, g, s, v) in enumerate([("A", "x", "p", 10), ("A", "x", "q", 1), ("A", "y", "p", 30), ("A", "y", "q", 1), ("B", "x", "p", 15), ("B", "x", "q", 1), ("B", "y", "p", 35), ("B", "y", "q", 1)])]
    frame = spark.createDataFrame(both, "o int, c string, g string, s string, v int")
    rows = coords.layout_bars(frame, "c", "o", shift_by="g", stack_by="s", value="v").orderBy("o").collect()
    assert [r["base"] for r in rows] == [0, 10, 0, 30, 0, 15, 0, 35]
    assert {round(r["offset"], 6) for r in rows} == {-0.2, 0.2} and {round(r["width"], 6) for r in rows} == {0.36}
    left = coords.layout_bars(frame, "c", "o", shift_by="g", align="left").collect()
    assert {round(r["offset"], 6) for r in left} == {-0.4, 0.0}
    with pytest.raises(ValueError):
        coords.layout_bars(frame.where("o > 0"), "c", "o")
    labels = coords.bar_labels(spark.createDataFrame([(10.0, 13.0), (20.0, float("nan"))], "v double, h double"), "v", "h").collect()
    assert [(r["label_text"], r["label_at"]) for r in labels] == [("10", 13.0), ("20", 20.0)]


def test_layout_overlap_example(spark):
    rows = [("foo", "foo::hist", 0x0, 0x4000, None, None, False), ("foo", "foo::histptr", 0x4000, 2, None, None, False), ("foo", "foo::hash", 0x4002, 0x4000, 0x4001, 0x8002, True)]
    frame = spark.createDataFrame(rows, "owner string, name string, byte_offset long, byte_size long, base long, top long, is_imprecise boolean")
    got = {r["name"]: (r["_alias_color"], r["_aliased_by"]) for r in layouts.annotated_members(frame, ["owner"]).collect()}
    assert got == {"foo::hist": (None, []), "foo::histptr": (None, [0]), "foo::hash": (0, [])}


def test_nested_rollup_and_cycles(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 10), (3, 100)], "id long, v long")
    edges = spark.createDataFrame([(1, 2, 2), (2, 3, 3), (1, 3, 1)], "parent long, child long, items long")
    assert {r["id"]: r["v"] for r in layouts.rollup_nested(nodes, edges, ["v"]).collect()} == {1: 1 + 20 + 700, 2: 310, 3: 100}
    with pytest.raises(ValueError):
        layouts.rollup_nested(nodes, edges.union(spark.createDataFrame([(3, 1, 1)], edges.schema)), ["v"])


def test_derived_columns(spark):
    frame = spark.createDataFrame([("a", 2048)], "k string, n long")
    refs = shape.References({"size": "n"})
    out = shape.derive(frame, "text", ["<size>"], "to_bytes_text", refs)
    out = shape.derive(out, "both", ["k", "<text>"], "concat", refs, separator="/")
    out = shape.derive(out, "m", ["k"], "map", values={"a": "A"})
    assert tuple(out.first()) == ("a", 2048, "2KiB", "a/2KiB", "A")
    for bad in (lambda: shape.derive(out, "m", ["k"], "identity"), lambda: refs.define("text", "x"), lambda: shape.derive(out, "z", ["k"], "nothing")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        refs.resolve("<none>")
    assert shape.columns_like(out, pattern="^[kn]$", types=["bigint"]) == ["n"]


def test_custom_order(spark):
    frame = spark.createDataFrame([("b", 1), ("a", 2), ("b", 2), ("a", 1)], "k string, n int")
    got = [tuple(r) for r in shape.custom_order(frame, {"k": ["b", "a"], "n": [2, 1]}).collect()]
    assert got == [("b", 2), ("b", 1), ("a", 2), ("a", 1)]
    with pytest.raises(ValueError):
        shape.custom_order(frame, {"k": ["b"]})


def test_matrix_and_merge(spark):
    axes = {"target": ["a", "b"], "arch": ["x", "y"], "n": [1, 2]}
    runs = keys.parameter_matrix(spark, axes, skip=[{"target": "b", "arch": "y"}], derived={"host": [({"arch": "x"}, "h1"), ({}, "h2")]})
    assert runs.count() == 6 and runs.select("dataset_id").distinct().count() == 6
    assert {(r["arch"], r["host"]) for r in runs.collect()} == {("x", "h1"), ("y", "h2")}
    with pytest.raises(Exception, match="no rule"):
        keys.parameter_matrix(spark, axes, derived={"host": [({"arch": "x"}, "h")]}).collect()
    with pytest.raises(ValueError):
        keys.parameter_matrix(spark, {"iteration": [1]})
    source = spark.createDataFrame([("s1", "a", "x", 1), ("s2", "a", "x", 2), ("s3", "b", "x", 3), ("s4", "c", "x", 4)], "dataset_id string, target string, arch string, ord int")
    m = keys.merge_by_key(source, runs.drop("host"), ["target", "arch", "n"], {"n": 2}, "ord")
    assert sorted(r["source_id"] for r in m.matched.collect()) == ["s2", "s3"]
    assert [r["runs"] for r in m.duplicates.collect()] == [2]
    assert [r["target"] for r in m.missing.collect()] == ["c"]
    moved = keys.move_runs(spark.createDataFrame([("s2", 5), ("s1", 6)], "dataset_id string, v int"), m).collect()
    assert [r["v"] for r in moved] == [5]
    for extra in ({}, {"n": 2, "target": "a"}, {"zz": 1}):
        with pytest.raises(ValueError):
            keys.merge_by_key(source, runs.drop("host"), ["target", "arch", "n"], extra, "ord")
    assert keys.axis_difference(["a", "b"], ["b", "c"]) == (["a"], ["c"])
    with pytest.raises(ValueError):
        keys.with_keys(source, runs, keys.Keys(("target",)))


def test_conformance(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n", T.IntegerType(), False), T.StructField("k", T.StringType())])
    frame = spark.createDataFrame([("1", "a", 0), ("x", "a", 0), ("2", "z", 0)], "n string, k string, extra int")
    assert [tuple(r) for r in checks.conform(frame, schema, {"k": ["a"]}).collect()] == [(1, "a")]
    with pytest.raises(ValueError):
        checks.conform(frame, schema, strict="raise")
    with pytest.raises(ValueError):
        checks.require_unique(frame, ["k"])
    assert checks.consistent(frame, ["k"], "n").count() == 1


def test_instruction_classes(spark):
    cases = [("ldr", "x0, [x1]", "ld_int"), ("ldrb", "w0, [x1]", "ld_int"), ("ldp", "c0, c1, [csp]", "ld_pair_cap"), ("ldr", "czr, [x0]", "ld_cap"), ("stp", "x0, x1, [x2]", "st_pair_int"), ("str", "c3, [x0]", "st_cap")]
    # Only these forms: atomics and unscaled ones are other, as are conversions and other capability instructions.
    cases += [("scbnds", "c0, c0, x1", "cheri"), ("scbndse", "c0, c0, x1", "cheri"), ("scvtf", "d0, x1", "other"), ("ldadd", "x0, x1, [x2]", "other"), ("ldur", "x0, [x1]", "other"), ("seal", "c0, c0, c1", "other"), ("ret", None, "other"), ("add", "x0, x1, x2", "other")]
    frame = spark.createDataFrame(cases, "m string, o string, want string")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", trace.instruction_class(F.col("m"), F.col("o"))).collect())
    assert one(spark, trace.is_kernel(F.lit("18446462598732840960").cast("decimal(20,0)")))


def test_left_range_join_after_a_shuffle(spark):
    # The same rows, whatever order and partitions the points come in.
    points = [(k % 40, k % 7) for k in range(400)]
    ranges = spark.createDataFrame([(5, 9, 0), (7, 700, 1), (30, 31, 2)], "low int, high int, rid int")
    want = None
    for parts in (1, 3, 17):
        p = spark.createDataFrame(points, "pos int, v int").repartition(parts, "v")
        got = sorted(map(str, intervals.range_join(p, ranges, "pos", "low", "high", how="left", bucket=2).collect()))
        want = want or got
        assert got == want and len(got) == 400 - 0 + sum(5 <= x < 9 and 7 <= x for x, _ in points) + sum(x == 30 for x, _ in points)


def test_orders_over_range_partitions(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, rng.choice([None, None, k])) for k in range(300)]
    frame = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    last: dict = {}
    want = {}
    for k, at, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[at] = last[k]
    assert {r["at"]: r["v"] for r in ordered.filled(frame, ["k"], ["at"], "v").collect()} == want
    total: dict = {}
    sums = {}
    for k, at, _ in rows:
        sums[at] = total.get(k, 0)
        total[k] = sums[at] + at
    assert {r["at"]: r["s"] for r in ordered.running(frame, ["k"], ["at"], {"s": "at"}).collect()} == sums
    assert {r["at"]: r["n"] for r in ordered.ranked(frame, "at", "at", "n").collect()} == {k: k for k in range(300)}


def test_no_window_takes_a_whole_table(spark):
    from runledger.plans import registry

    for name in ("nearest_part_price", "resolved_symbols", "bar_layout", "striped_names", "iteration_windows", "filled_values"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # A window without keys runs over one row for each partition, never over rows of a table.
        assert all("_range" in line or "[user_id" in line for line in plan.splitlines() if "Window [" in line), plan


def test_instructions_of_a_call(spark):
    n = spark.createDataFrame([("f", "a", 10.0), ("f", "b", 30.0), ("g", "b", 5.0)], "symbol string, run string, n double")
    calls = spark.createDataFrame([("f", "a", 2), ("f", "b", 3), ("g", "b", 0)], "symbol string, run string, calls int")
    got = trace.per_call(n, calls, ["symbol"], ["run"], "a").collect()
    assert [(r["symbol"], r["insn_per_call"], r["delta_insn_per_call"]) for r in got] == [("f", 10.0, 5.0)]


def test_counter_ratios(spark):
    counts = {"cpu_cycles": 100, "inst_retired": 50, "stall_backend": 20, "inst_spec": 80, "br_mis_pred": 1, "br_pred": 4, "l1i_cache": 10, "l1i_cache_refill": 1, "l1d_cache": 8, "l1d_cache_refill": 2}
    frame = spark.createDataFrame([("g1", k, float(v)) for k, v in counts.items()] + [("g2", "cpu_cycles", 7.0)], "g string, name string, value double")
    got = {(r["g"], r["name"]): r["value"] for r in shape.with_derived_metrics(frame, ["g"], "name", "value").collect() if r["name"] not in counts}
    assert got == {("g1", k): v for k, v in {"cycles_per_insn": 2.0, "ipc": 0.5, "br_pred_miss_rate": 0.25, "insn_spec_rate": 0.625, "eff_backend_ipc": 0.625, "l1i_hit_rate": 0.9, "l1d_hit_rate": 0.75}.items()}


def test_trigger_window_without_hits(spark):
    frame = spark.range(10).select(F.col("id").alias("line"), (F.col("id") % 4).alias("pc"))
    assert [r["line"] for r in trace.trigger_window(frame, "line", "pc", start=2, stop=1, hits=3).orderBy("line").collect()] == [2, 3, 4, 5, 6, 7, 8]
    assert trace.trigger_window(frame, "line", "pc", start=99).count() == 0
    assert trace.trigger_window(frame, "line", "pc", stop=1, hits=9).count() == 10


def test_plans_have_no_cartesian_products(spark):
    from runledger.plans import registry

    for name in ("range_join_dealt", "nearest_part_price", "merged_intervals", "alias_pairs", "price_histogram"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def _all_windows(df):
    """The keys of every window of a plan."""
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [tuple(sorted(re.sub(r"#\d+L?", "", k).strip() for k in m.split(","))) for m in re.findall(r"^[\s:+-]*Window \[.*?\], \[(.*?)\]", plan, re.M)]


def test_neighbours_over_range_partitions(spark):
    rng = random.Random(8)
    # One key holds a third of the rows, some rows are equal in the order, some throughout.
    rows = [(rng.choice(["hot", "a", None]), rng.randrange(60), rng.randrange(4)) for _ in range(900)]
    frame = spark.createDataFrame(rows, "k string, at int, v int").repartition(7)
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = ordered.running(frame, ["k"], ["at"], {"n": "1L"}, following={"after": "v", "after_at": "at"}, preceding={"ahead": "v"}).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        for k in ("hot", "a", None):
            own = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
            assert [r["n"] for r in own] == list(range(len(own)))
            assert [r["at"] for r in own] == sorted(x for q, x, _ in rows if q == k)
            # Every row follows one row and is followed by one.
            assert [r["after"] for r in own] == [r["v"] for r in own[1:]] + [None]
            assert [r["after_at"] for r in own] == [r["at"] for r in own[1:]] + [None]
            assert [r["ahead"] for r in own] == [None] + [r["v"] for r in own[:-1]]


def test_no_window_holds_a_whole_key(spark):
    events = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("user"), F.col("id").alias("ts"), (F.col("id") % 5).alias("state"))
    spans = events.select("user", F.col("ts").alias("low"), (F.col("ts") + F.col("state")).alias("high"), F.lit(1).alias("w"))
    frames = {
        "successive": trace.successive(events, ["user"], ["ts"], "state"),
        "nesting": trace.nesting(events, ["user"], ["ts"], F.col("state") < 3),
        "windows": intervals.iteration_windows(events.where("state = 1"), events, ["user"], "ts"),
        "merged": intervals.merge_intervals(spans, ["user"], "low", "high", "w"),
    }
    for name, df in frames.items():
        windows = _all_windows(df)
        assert windows, name
        # What isn't inside a range partition has one row for each range and key.
        assert all("_range" in keys for keys in windows if keys != ("user",) and keys != ("depth", "user")), (name, windows)
    # A user of a third of the rows fills several ranges.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = ordered._ranged(events, ["user"], ["ts"])[0].where("user = 0").select("_range").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1


def test_one_thread_nests_over_many_tasks(spark):
    rng = random.Random(3)
    steps, depth = [], 0
    for k in range(2000):
        up = depth == 0 or rng.random() < 0.5
        depth += 1 if up else -1
        steps.append((1, k, up))
    frame = spark.createDataFrame(steps, "thread int, at int, up boolean").repartition(9)
    got = sorted(trace.nesting(frame, ["thread"], ["at"], F.col("up")).collect(), key=lambda r: r["seq"])
    depth, latest = 0, {}
    for r, (_, _, up) in zip(got, steps, strict=True):
        depth -= 0 if up else 1
        assert (r["depth"], r["previous"]) == (depth, latest.get(depth))
        latest[depth] = r["seq"]
        depth += 1 if up else 0


def test_rollup_of_a_deep_chain_and_of_a_cycle(spark):
    n = 1000
    nodes = spark.range(n).select("id", F.lit(1).cast("long").alias("v"))
    chain = spark.range(1, n).select((F.col("id") - 1).alias("parent"), F.col("id").alias("child"), F.lit(1).alias("items"))
    got = {r["id"]: r["v"] for r in layouts.rollup_nested(nodes, chain, ["v"]).collect()}
    assert got == {k: n - k for k in range(n)}
    for back in (n - 1, 5):
        cycle = chain.where(f"child <= {back}").union(spark.createDataFrame([(back, 3, 1)], chain.schema))
        with pytest.raises(ValueError, match="contain each other"):
            layouts.rollup_nested(nodes, cycle, ["v"])


def test_completion_beyond_the_names_of_a_task(spark, monkeypatch):
    rows = [(k, n, (k or 0) * n) for k in [*range(7), None] for n in range(50) if k is None or (k + n) % 3]
    frame = spark.createDataFrame(rows, "k int, n int, v int")
    few = sorted(map(str, align.completed(frame, ["k"], ["n"], ["v"], fill=0).collect()))
    monkeypatch.setattr(align, "MOST_NAMES", 8)
    many = align.completed(frame, ["k"], ["n"], ["v"], fill=0)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    got = many.collect()
    assert sorted(map(str, got)) == few and len(got) == 8 * 50


def test_quantiles_of_a_group_beyond_one_task(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.randrange(50) / 4, None])) for _ in range(2000)] + [(None, float(k)) for k in range(31)] + [("nan", x) for x in (1.0, float("nan"), 2.0)] + [("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").withColumn("w", -F.col("v"))
    wanted = {"low": ("v", 0.05), "mid": ("v", 0.5), "high": ("w", 0.9)}
    small = {r["g"]: str(r) for r in quantiles.quantiles(frame, ["g"], wanted).collect()}
    whole = quantiles.quantiles(frame.where("g = 'hot'"), [], wanted).collect()
    monkeypatch.setattr(quantiles, "TABLE_ROWS", 100)
    assert {r["g"]: str(r) for r in quantiles.quantiles(frame, ["g"], wanted).collect()} == small
    assert quantiles.quantiles(frame.where("g = 'hot'"), [], wanted).collect() == whole


def test_overlaps_in_a_large_structure(spark):
    n = 100_000
    members = spark.range(n).select(F.lit("s").alias("owner"), F.concat(F.lit("s::m"), F.col("id").cast("string")).alias("name"), (8 * F.col("id")).alias("byte_offset"), F.lit(8).cast("long").alias("byte_size"), (8 * F.col("id") - 4).alias("base"), (8 * F.col("id") + 12).alias("top"), (F.col("id") % 2 == 0).alias("is_imprecise"))
    began = time.perf_counter()
    # Bounds reach into the member before and the one after.
    assert layouts.alias_pairs(members, ["owner"]).count() == n - 1
    assert time.perf_counter() - began < 60
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"x::{k}" if k % 3 else f"x::{k - 1}::{k}", (o := rng.randrange(60)), rng.choice([0, 1, 8]), (b := max(0, o - rng.randrange(9))), b + rng.randrange(12), rng.random() < 0.4) for k in range(150)]
    frame = spark.createDataFrame(rows, "owner string, name string, byte_offset long, byte_size long, base long, top long, is_imprecise boolean")
    related = lambda p, q: p == q or p.startswith(q + "::") or q.startswith(p + "::")
    want = sorted((o, m, f, a) for o, m, f, s, *_ in rows for o2, a, _, _, b, t, i in rows if i and o == o2 and f < t and f + s > b and not related(m, a))
    assert sorted(map(tuple, layouts.alias_pairs(frame, ["owner"]).collect())) == want


def test_violations_are_counted_in_the_pass_that_writes(spark, tmp_path):
    from pyspark.sql import types as T

    from runledger.sources.sinks import write_conforming

    frame = spark.createDataFrame([("1", "a", 0), ("x", "a", 0), (None, "b", 0), ("4", None, 0), ("5", "c", 0)], "n string, k string, extra int")
    schema = T.StructType([T.StructField("n", T.IntegerType(), False), T.StructField("k", T.StringType())])
    counts = write_conforming(frame, schema, f"file://{tmp_path}/out", {"k": ["a", "b"]})
    assert counts == {"rows": 5, "n_type": 1, "n_null": 2, "k_type": 0, "k_value": 1}
    assert sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out").collect())) == sorted(["Row(n=1, k='a')", "Row(n=4, k=None)"])
